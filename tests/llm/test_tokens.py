import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from wideflow.llm import tokens
from wideflow.llm.common import pick
from wideflow.llm.piece_bpe import MARK, PieceBPE

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return PieceBPE(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(both):
    bpe, sp = both
    rng = random.Random(3)
    alphabet = "aethn  ▁\n\té漢的①🙂 ﷺ.!0123  the\x00"
    for _ in range(4000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = sp.encode(x)
        assert bpe.encode(x) == ids
        assert bpe.decode(ids) == sp.decode(ids)
        assert bpe.encode_joined(x) == (ids, ",".join(map(str, ids)))
    for n in range(70):
        assert bpe.encode(" " * n) == sp.encode(" " * n)
    long = "".join(rng.choice("aethnoisr") for _ in range(50_000))
    assert bpe.encode(long) == sp.encode(long)


def test_decode_of_any_ids(both):
    bpe, sp = both
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 10))]
        assert bpe.decode(ids) == sp.decode(ids)


def test_backtracking_equals_the_merge_loop(both):
    bpe, _ = both
    rng = random.Random(5)
    for _ in range(500):
        x = MARK + "".join(rng.choice("theandiorsnmc") for _ in range(rng.randint(1, 18)))
        assert [bpe.piece[i] for i in bpe._segment(x)] == bpe.merged(x)


def test_documents(spark, both, make_docs, edge_rows):
    _, sp = both
    docs = make_docs(edge_rows)
    want = Counter()
    for i, t, _, _ in edge_rows:
        ids = sp.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    out = tokens.encode_documents(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert tokens.encode_documents(docs.limit(0)).count() == 0
    back = tokens.decode_ids(tokens.encode_documents(docs)).collect()
    assert Counter(r.text for r in back) == Counter((t or "").replace(MARK, " ") for _, t, _, _ in edge_rows)
    rows = tokens.with_ids(docs)
    assert rows.columns == [*docs.columns, "n_tokens", "ids"]
    assert rows.count() == len(edge_rows)


def test_histogram(spark, both, make_docs, edge_rows):
    _, sp = both
    docs = make_docs(edge_rows)
    lengths = [(s, len(sp.encode(t or ""))) for _, t, _, s in edge_rows]
    hist = tokens.length_histogram(docs)
    rows = hist.collect()
    for scope, source, own in [("all", None, [n for _, n in lengths])] + [
            ("source", s, [n for x, n in lengths if x == s]) for s in {s for s, _ in lengths}]:
        part = [r for r in rows if r.scope == scope and r.source == source]
        assert {r.n_tokens: r.n_docs for r in part} == Counter(own)
        for r in part:
            longer = [n for n in own if n >= r.n_tokens]
            assert (r.docs_at_least, r.tokens_at_least) == (len(longer), sum(longer))
            assert (r.total_docs, r.total_tokens) == (len(own), sum(own))
            assert r.docs_at_most == sum(n <= r.n_tokens for n in own)
            assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in own)
    own = [n for _, n in lengths]
    for r in tokens.at_limits(hist, [0, 5, 128, 10**6]).where("scope = 'all'").collect():
        assert (r.docs_cut, r.kept_tokens) == (sum(n > r.limit for n in own), sum(min(n, r.limit) for n in own))
    for r in tokens.length_quantiles(hist, [0.1, 0.5, 1.0]).where("scope = 'all'").collect():
        assert r.n_tokens == min(x for x in own if sum(n <= x for n in own) >= r.share * len(own))
    assert tokens.length_histogram(docs.limit(0)).count() == 0
    assert pick(docs, "text").count() == len(edge_rows)
