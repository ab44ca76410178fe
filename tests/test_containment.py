"""Terms in texts by their rarest gram, against a test of all pairs: short terms, empty and null ones, repeats, texts of any length."""

import random

from cadastra.operators.containment import containments, meeting


def test_containments(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("ab cé", k=n))
    texts = [(i, text(rng.choice([0, 1, 3, 5, 12, 40]))) for i in range(200)] + [(300, None), (301, "x" * 50_000 + "needle"), (None, "abab")]
    terms = [(i, text(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(120)] + [(500, ""), (501, None), (502, "needle"), (503, "nowhere"), (504, "a"), (505, "xxxxx"), (None, "ab")]
    want = {(i, j) for i, t in texts for j, w in terms if t and w and i is not None and j is not None and w in t}
    a, b = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    got = [tuple(r) for r in containments(a, b).collect()]
    assert len(got) == len(want) and set(got) == want and (301, 502) in want
    assert containments(a.limit(0), b).count() == 0 and containments(a, b.limit(0)).count() == 0
    # a term waits at the gram that the fewest texts have
    some = spark.createDataFrame([(1, "common rare"), (2, "common text"), (3, "common text")], "text_id long, text string")
    one = spark.createDataFrame([(9, ["comm", "rare"])], "term_id long, grams array<string>")
    assert [tuple(r) for r in meeting(some, one).collect()] == [(1, 9)]
