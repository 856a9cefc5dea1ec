from peergraph.operators import cohorts as H

PRECEDENCE = {"impl": 0, "base": 1, "suffix": 2, "kind": 3, "ns": 4}


def assigned(spark, subjects, floor=5):
    rows = [(s, place, key, key.split(":")[0], PRECEDENCE[key.split(":")[0]]) for s, keys in subjects.items() for place, key in enumerate(keys)]
    listed = spark.createDataFrame(rows, "type_id string, place int, key string, basis string, precedence int")
    return {r.type_id: r.key for r in H.reconcile(H.assign(listed, floor), listed, floor).collect()}


def test_the_most_specific_viable_basis_wins(spark):
    found = assigned(spark, {f"a{i}": ["impl:I", "ns:N"] for i in range(5)} | {f"b{i}": ["ns:N"] for i in range(5)})
    assert {found[f"a{i}"] for i in range(5)} == {"impl:I"}
    assert {found[f"b{i}"] for i in range(5)} == {"ns:N"}


def test_a_rare_interface_is_not_enough(spark):
    found = assigned(spark, {f"a{i}": ["impl:I", "ns:N"] for i in range(4)} | {f"b{i}": ["ns:N"] for i in range(6)})
    assert set(found.values()) == {"ns:N"}


def test_the_stranded_are_moved(spark):
    subjects = {f"a{i}": ["impl:I", "suffix:S", "ns:N"] for i in range(8)} | {"b": ["suffix:S", "ns:N"]} | {f"c{i}": ["ns:N"] for i in range(5)}
    found = assigned(spark, subjects)
    assert found["b"] == "ns:N"
    assert found["a0"] == "impl:I"


def test_lone_suffixes_meet_in_the_namespace(spark):
    found = assigned(spark, {f"a{i}": [f"suffix:S{i}", "ns:N"] for i in range(3)} | {f"b{i}": ["ns:N"] for i in range(2)})
    assert set(found.values()) == {"ns:N"}


def test_an_interface_listed_twice_counts_twice(spark):
    found = assigned(spark, {f"a{i}": ["impl:I", "impl:I", "ns:N"] for i in range(3)})
    assert set(found.values()) == {"impl:I"} or set(found.values()) == {"ns:N"}
    listed = spark.createDataFrame([("a", 0, "impl:I", "impl", 0), ("a", 1, "impl:I", "impl", 0)], "type_id string, place int, key string, basis string, precedence int")
    assert H.candidate_counts(listed).first().listed == 2


def test_subjects_without_candidates_are_found(spark):
    listed = spark.createDataFrame([("a", "k")], "type_id string, key string")
    assert [r.type_id for r in H.without_candidates(spark.createDataFrame([("a",), ("b",)], "type_id string"), listed).collect()] == ["b"]
