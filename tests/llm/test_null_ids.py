"""Near copies whose rows have no id link like all others."""

from cases import documents
from test_repeats import by_brute_force

from fieldspark.llm import jaccard_join


def changed(words, places, mark):
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(words)]


def test_near_copies_without_an_id_tie_components(spark):
    one = [f"word{i}" for i in range(400)]
    between = changed(one, range(5, 100, 15), "x")
    two = changed(between, range(205, 300, 15), "y")
    other = [f"other{i}" for i in range(300)]
    rows = [
        (1, " ".join(one)),
        (None, " ".join(between)),
        (None, " ".join(between)),
        (2, " ".join(two)),
        (None, " ".join(changed(other, [50], "z"))),
        (3, " ".join(other)),
    ]
    assert by_brute_force([rows[0], rows[3]], 4, 85)[1][2] == "2"
    found = jaccard_join.jaccard_components(documents(spark, rows), 4, 85).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)
    assert got == by_brute_force(rows, 4, 85)
    assert {r.component_id for r in found} == {1, 3}
    kept = jaccard_join.keep_smallest(documents(spark, rows), 4, 85).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None", "None", "None"]
