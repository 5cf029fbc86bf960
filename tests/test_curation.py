import pytest
from catalog_helpers import named, near, of, unit

from lightbox.functions import names
from lightbox.operators import curation
from lightbox.operators.curation import ActionError


@pytest.fixture()
def base(make):
    faces = [{"id": 1, "cluster": 1}, {"id": 2, "cluster": 1, "conf": 0.95}, {"id": 3, "cluster": 2}, {"id": 4}, {"id": 5, "dismissed": 1}]
    return make(faces, [(1, "Alice"), (2, "maybe Bob"), (3, "Person_001")])


def fails(status, f, *args):
    with pytest.raises(ActionError) as e:
        f(*args)
    assert e.value.status == status


def test_sanitise(spark):
    cases = {"Al/ice<>": "Al_ice__", "Weird/Name": "Weird_Name", " Dan. ": "Dan", "...": "unnamed", "": "unnamed", "a\x00b": "a_b", "\t x \n": "_ x _", " .x. ": "x", "  x ": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r["name"]: r["safe"] for r in df.select("name", names.sanitized(df["name"]).alias("safe")).collect()}
    assert got == cases and {k: names.sanitize(k) for k in cases} == cases


def test_rename(base, make):
    state, result = curation.rename_person_full(base, 3, "maybe X")
    assert result == {"name": "maybe X"} and named(state)[3] == "maybe X"
    assert curation.rename_person_full(base, 99, "X")[1] is None and not curation.rename_person(base, 99, "X")[1]
    a = unit(1)
    c = make([{"id": i, "v": near(a, i), "cluster": 1} for i in (1, 2)] + [{"id": 3, "v": near(a, 3)}, {"id": 4, "v": unit(70001)}, {"id": 5, "v": unit(70002), "cluster": 2}], [(1, "Person_001"), (2, "maybe Ann_Lee")])
    state, result = curation.rename_person_full(c, 1, "Ann/Lee")
    assert result == {"name": "Ann_Lee", "absorbed_faces": 1, "merged_clusters": 1}
    assert of(state) == {1: 1, 2: 1, 3: 1, 4: None, 5: 1} and named(state) == {1: "Ann_Lee"}


def test_merge(base):
    state = curation.merge_people(base, 1, 2)
    assert of(state)[3] == 1 and 2 not in named(state)
    fails(400, curation.merge_people, base, 1, 1)
    fails(404, curation.merge_people, base, 1, 9)


def test_split(base):
    state, result = curation.split_face(base, 1)
    assert result == {"cluster_id": 4, "name": "Split_1"} and of(state)[1] == 4
    assert curation.split_face(base, 1, "Weird/Name")[1]["name"] == "Weird_Name"
    fails(404, curation.split_face, base, 77)
    fails(400, curation.split_faces, base, [])
    state, result = curation.split_faces(base, [1, 2, 5])
    assert len(result["cluster_ids"]) == 1 and named(state)[result["cluster_ids"][0]] == "Split" and of(state)[5] is None


def test_split_by_similarity_numbers_groups(make):
    a, b = unit(1), unit(999)
    c = make([{"id": 1, "v": near(a, 1), "cluster": 1}, {"id": 2, "v": near(a, 2), "cluster": 1}, {"id": 3, "v": near(b, 3), "cluster": 1}], [(1, "x")])
    state, result = curation.split_faces(c, [1, 2, 3], "New")
    assert sorted(named(state).values()) == ["New 1", "New 2", "x"] and of(state)[1] == of(state)[2] != of(state)[3]


def test_dismiss_and_restore(base):
    state = curation.dismiss_face(base, 1)
    row = state.faces.where("id = 1").first()
    assert row["dismissed"] == 1 and row["cluster_id"] is None
    row = curation.restore_face(state, 1).faces.where("id = 1").first()
    assert row["dismissed"] == 0 and row["cluster_id"] is None
    fails(404, curation.dismiss_face, base, 99)
    fails(404, curation.restore_face, base, 99)
    state, n = curation.dismiss_cluster(base, 1)
    assert n == 2 and 1 not in named(state) and state.faces.where("dismissed = 1").count() == 3
    assert curation.dismiss_many(base, [1, 2])[1] == 3
    fails(404, curation.dismiss_cluster, base, 99)


def test_moves(base):
    assert of(curation.move_face(base, 4, 2))[4] == 2
    state, n = curation.move_faces(base, [1, 4, 999], 3)
    assert n == 3 and of(state)[1] == of(state)[4] == 3
    fails(404, curation.move_face, base, 99, 1)
    fails(404, curation.move_face, base, 1, 99)
    fails(404, curation.move_faces, base, [1], 99)
    fails(400, curation.move_faces, base, [], 1)


def test_delete_photo(base):
    state = curation.delete_photo(base, 1)
    assert state.photos.where("id = 1").count() == 0 and 1 not in of(state)

    def gone(path):
        raise FileNotFoundError(path)

    def locked(path):
        raise PermissionError(path)

    assert 1 not in of(curation.delete_photo(base, 1, gone))
    fails(409, curation.delete_photo, base, 1, locked)
    fails(404, curation.delete_photo, base, 99)


def test_assignments_may_be_null(spark, base):
    moves = spark.createDataFrame([(1, None), (4, 2)], "face_id long, new_cluster_id long")
    got = of(curation.assign_faces(base, moves))
    assert got[1] is None and got[4] == 2 and got[2] == 1


def test_require_int():
    assert curation.require_int("7", "x") == 7
    for bad in (None, "a", 1.5, True):
        with pytest.raises(ActionError):
            curation.require_int(bad, "x")


def test_problems_show_what_is_broken(base):
    assert base.problems().count() == 0
    leak = curation.assign_face(base, 5, 1)
    assert [tuple(r) for r in leak.problems().collect()] == [("dismissed face in a cluster", 5)]
