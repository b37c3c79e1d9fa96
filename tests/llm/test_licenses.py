import random
import re

from wideflow.llm import licenses


def brute(text, templates):
    """(template, start, words, containment) by comparing every stretch of the text."""
    w, out = licenses.words_of(text or ""), set()
    for i, (_, t) in enumerate(templates):
        tw = licenses.words_of(t)
        want, k = licenses.shingles(tw), min(licenses.SHINGLE, len(tw))
        if not tw:
            continue
        versions = {x for x in tw if re.search(rb"[0-9]", x)}
        span = len(tw) - k + 1 + len(tw) // 5
        sh = [tuple(w[p:p + k]) for p in range(len(w) - k + 1)]
        p = 0
        while p < len(sh):
            if sh[p] in want:
                share = len(want & set(sh[p:p + span])) / len(want)
                last = max(q for q in range(p, min(p + span, len(sh))) if sh[q] in want)
                if share >= licenses.CONTAINMENT and versions <= set(w[p:last + k]):
                    out.add((i, p, last - p + k, share))
                    p = last + k
                    continue
            p += 1
    return out


def test_scan_equals_brute_force(spark, make_docs, edge_rows):
    rng = random.Random(1)
    rows = list(edge_rows)
    for i in range(150):
        text = edge_rows[i % 50][1].split()
        _, notice = licenses.NOTICES[i % len(licenses.NOTICES)]
        words = notice.split()
        if i % 3 == 1 and len(words) > 12:
            words[rng.randrange(len(words))] = "changed"  # five shingles differ
        if i % 3 == 2:
            words = [w.upper() for w in words]
        at = rng.randint(0, len(text))
        rows.append((1000 + i, " ".join(text[:at]) + "\n" + " ".join(words) + " \t" + " ".join(text[at:]), "en", "a"))
    out = licenses.scan_licenses(make_docs(rows)).collect()
    want = {(i, *m) for i, t, _, _ in rows for m in brute(t, licenses.NOTICES)}
    assert {(r.doc_id, r.template_id, r.start_word, r.n_words, r.containment) for r in out} == want
    assert len(want) > 100
    assert all(r.containment >= licenses.CONTAINMENT for r in out)
    exact = licenses.scan_licenses(make_docs([(1, "x y " + licenses.NOTICES[0][1] + " z", "en", "a")])).collect()
    assert [(r.license, r.start_word, r.n_words, r.containment) for r in exact if r.best] == [("Apache-2.0", 2, 8, 1.0)]


def test_blocks_of_templates_and_empty_input(spark, make_docs, monkeypatch):
    docs = make_docs([(1, "all rights reserved. one two three four five six", "en", "a"), (2, None, None, None)])
    monkeypatch.setattr(licenses, "TEMPLATES_PER_PASS", 1)
    own = [("A", "All rights reserved"), ("none", ""), ("B", "two three four five six")]
    out = licenses.scan_licenses(docs, own).collect()
    assert sorted((r.doc_id, r.license) for r in out) == [(1, "A"), (1, "B")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, []).count() == 0


def test_band_guarantee():
    for n in (1, 3, 17, 200):
        j = licenses.least_jaccard(n, max(1, n // 8))
        assert (1 - j) ** licenses.bands(j) <= licenses.MISS * (1 + 1e-9)


def test_versions_must_match_and_the_best_match_is_marked(spark, make_docs):
    gpl2 = next(t for n, t in licenses.NOTICES if n == "GPL-2.0" and "work" in t)
    header = next(t for n, t in licenses.NOTICES if n == "GPL-2.0" and "program" in t)
    docs = make_docs([(1, "a b c " + gpl2 + " d e", "en", "a"), (2, "x " + header + " y z", "en", "a"),
                      (3, gpl2.replace("version 2", "version 9"), "en", "a"),
                      (4, header + " " + gpl2, "en", "a")])
    out = licenses.scan_licenses(docs).collect()
    best = {}
    for r in out:
        if r.best:
            best.setdefault(r.doc_id, []).append(r.license)
    assert {i: sorted(x) for i, x in best.items()} == {1: ["GPL-2.0"], 2: ["GPL-2.0"], 4: ["GPL-2.0", "GPL-2.0"]}
    assert not any(r.doc_id in (1, 3) and r.license == "GPL-3.0" for r in out)
    for i in (1, 2, 4):                                   # best matches do not overlap
        spans = sorted((r.start_word, r.start_word + r.n_words) for r in out if r.doc_id == i and r.best)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
