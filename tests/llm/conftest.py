import random

import pytest

WORDS = ("the of and to in that it was for on are with as his they be at one have this from or had by "
         "hot word but what some we can out other were all there when up use your how said an each she").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with edge rows: NULLs, empty and blank texts, ties, repeated
    rows, a very long text, and extra columns whose names clash."""
    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        if not extra:
            return spark.createDataFrame(rows, schema)
        schema += ", Text string, DOC_ID string, size string, shard string, _key string, key string, _c0 string"
        return spark.createDataFrame([(*r, "x", "y", "z", "s", "k", "m", "c") for r in rows], schema)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    base = [(i, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "fr", None]),
             rng.choice(["a", "b", "b", "b", None])) for i in range(60)]
    long = sentence(rng, 30_000)
    return base + [(60, None, "en", "a"), (61, "", "en", "a"), (62, " \n\t ", None, None), (None, "a lone row", "en", "b"),
                   (None, "a lone row", "en", "b"), (63, long, "en", "b"), (64, base[3][1], "en", "a"),
                   base[5], base[5], base[5], (65, "é漢 ▁ \x00 end", "fr", "é")]
