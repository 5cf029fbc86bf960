import os
import subprocess
import sys

from catalog_helpers import ROOT


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 11 and {"id", "name", "face_count", "face_id"} <= set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    for name in ("lightbox", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lightbox" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dashboard' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=60)
