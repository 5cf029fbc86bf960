"""Helpers of the catalog's tests, apart from conftest.py so that its name can't clash with another one's."""

import os

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def unit(seed: int, dim: int = 512) -> np.ndarray:
    v = np.random.RandomState(seed).randn(dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def near(base: np.ndarray, seed: int, noise: float = 0.02) -> np.ndarray:
    v = base + np.random.RandomState(seed).randn(len(base)) * noise
    return (v / np.linalg.norm(v)).astype(np.float32)


def of(catalog) -> dict:
    """face id -> cluster id."""
    return {r["id"]: r["cluster_id"] for r in catalog.faces.select("id", "cluster_id").collect()}


def named(catalog) -> dict:
    return {r["id"]: r["name"] for r in catalog.clusters.select("id", "name").collect()}
