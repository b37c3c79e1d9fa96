import random

from wideflow.llm import substrings


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def shared(texts, n):
    """doc ids that hold n words in a row which a smaller doc_id has too."""
    first, out = {}, set()
    for i in sorted(texts):
        w = (texts[i] or "").split()
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            if first.setdefault(k, i) != i:
                out.add(i)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        lines = [" ".join(words(rng, rng.randint(3, 80))) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(lines), "en", "a"))
    passage = " ".join(words(rng, 60))
    for i in range(0, 60, 2):                             # in the middle of a line
        j, t, lang, s = rows[i]
        w = t.split(" ")
        at = rng.randint(0, len(w))
        rows[i] = (j, " ".join([*w[:at], passage, *w[at:]]), lang, s)
    line = words(rng, 60)
    for i in range(61, 100, 2):                           # near copies of a line: one word differs
        own = list(line)
        if i > 61:
            own[rng.randrange(60)] = f"other{i}"
        rows[i] = (rows[i][0], rows[i][1] + "\n" + " ".join(own), "en", "a")
    return rows


def test_planted_passages_go_and_clean_rows_stay(spark, make_docs, edge_rows):
    rows = corpus() + [(None, None, None, None), (500, "", "en", "a"), (501, "short line", "en", "a"),
                       (502, "short line", "en", "a")]
    docs = make_docs(rows)
    texts = {i: t for i, t, _, _ in rows if i is not None}
    found = substrings.repeated_passages(docs).collect()
    got = {r.doc_id for r in found}
    planted = set(range(2, 60, 2)) | set(range(63, 100, 2))
    assert got == planted
    assert all(r.kept_doc_id in (0, 61) or r.kept_doc_id < r.doc_id for r in found)
    assert {r.doc_id for r in found if r.kind == "paragraph"} >= set(range(63, 100, 2))
    out = substrings.remove_passages(docs)
    assert out.columns == docs.columns
    left = {r[0]: (r[1], r[4]) for r in out.collect()}
    assert set(texts) - set(left) <= planted and None in left
    for i, t in texts.items():
        if i not in planted:
            assert left[i][0] == t
    assert all(n == len(t) for t, n in left.values() if t is not None)
    assert not shared({i: t for i, (t, _) in left.items() if i is not None}, 50)


def test_repeated_rows_empty_tables_and_whole_copies(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    assert substrings.repeated_passages(docs.limit(0)).count() == 0
    assert substrings.remove_passages(docs.limit(0)).count() == 0
    rng = random.Random(3)
    text = " ".join(words(rng, 70))
    copies = make_docs([(1, text, "en", "a")] * 3 + [(2, text, "en", "a"), (3, text + " and more", "en", "a")])
    out = [(r[0], r[1]) for r in substrings.remove_passages(copies).collect()]
    # rows equal in id and text are one document; a whole copy leaves nothing
    assert out.count((1, text)) == 3 and all(i != 2 for i, _ in out)


def test_cuts_do_not_depend_on_the_place():
    rng = random.Random(5)
    passage = words(rng, 40)
    a = substrings.Texts([" ".join(words(rng, 30) + passage + words(rng, 30))])
    b = substrings.Texts(["x", " ".join(words(rng, 11) + passage)])
    hashes = [set(t.pieces()[3].tolist()) for t in (a, b)]
    assert len(hashes[0] & hashes[1]) >= 2


def test_piece_cover_and_removal():
    t = substrings.Texts(["", "one", "a b c d e f g h i j k l m n o p", " \n "])
    text, start, n, _ = t.pieces()
    own = [(int(s), int(k)) for i, s, k in zip(text, start, n) if i == 2]
    assert own[0][0] == 0 and sum(k for _, k in own) == 16
    assert all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    cut = substrings.cut_words
    assert substrings.without("a b  c\nd e", cut(5, [(1, 2)], [])) == "a d e"
    assert substrings.without("a b c", cut(3, [(0, 2), (1, 2)], None)) == ""
    assert substrings.without("a b c", cut(3, [(0, 3)], [(1, 1)])) == "b "


def test_passages_of_twenty_words_are_found_to_the_word(spark, make_docs):
    rng = random.Random(8)
    rows, planted = [], {}
    for i in range(0, 200, 2):
        passage = words(rng, 20 + i % 40)
        for j in (i, i + 1):
            left = words(rng, rng.randint(5, 60))
            rows.append((j, " ".join(left + passage + words(rng, rng.randint(5, 60))), "en", "a"))
        planted[i + 1] = (len(left), len(passage), i)
    short = words(rng, 19)                                # one word too few
    rows += [(300 + i, " ".join(words(rng, 9) + short + words(rng, 9)), "en", "a") for i in range(2)]
    found = substrings.repeated_passages(make_docs(rows)).collect()
    assert {r.doc_id: (r.start_word, r.n_words, r.kept_doc_id) for r in found} == planted
    assert len(found) == len(planted) and {r.kind for r in found} == {"passage"}
    left = {r[0]: r[1] for r in substrings.remove_passages(make_docs(rows)).collect()}
    for i, t, _, _ in rows:
        a, n, _ = planted.get(i, (0, 0, None))
        assert left[i].split() == t.split()[:a] + t.split()[a + n:]


def test_short_lines_and_hard_wrapped_paragraphs_are_units(spark, make_docs):
    rng = random.Random(9)
    block, line = words(rng, 240), " ".join(words(rng, 10))
    wrap = lambda w: "\n".join(" ".join(w[i:i + 12]) for i in range(0, len(w), 12))
    rows, own = [], {}
    for i in range(4):                                    # near copies: a word in 60 differs
        w = list(block)
        for at in range(7 * i, 240, 60) if i else ():
            w[at] = f"edit{i}x{at}"
        own[i] = rng.randint(30, 50)
        rows.append((i, " ".join(words(rng, own[i])) + "\n \n" + wrap(w) + "\n\n" + wrap(words(rng, 30)), "en", "a"))
    rows += [(10 + i, " ".join(words(rng, 30)) + "\n" + line + "\n" + " ".join(words(rng, 30)), "en", "a")
             for i in range(2)]
    found = {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id)
             for r in substrings.repeated_passages(make_docs(rows)).collect() if r.kind == "paragraph"}
    assert {(i, own[i], 240, 0) for i in (1, 2, 3)} <= found
    assert {x for x in found if x[0] >= 10} == {(11, 30, 10, 10)}


def windows_of(text, n=20):
    w = (text or "").split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def stands(rows, out):
    """Of the windows that two documents or more had: those that stand nowhere now."""
    from collections import Counter
    had = Counter(x for t in {(i, t) for i, t, *_ in rows} for x in windows_of(t[1]))
    left = {x for t in out for x in windows_of(t)}
    return {x for x, c in had.items() if c > 1} - left


def test_a_quote_of_an_edited_copy_is_not_lost(spark, make_docs):
    rng = random.Random(11)
    line = words(rng, 300)
    edited = line[:140] + words(rng, 20) + line[160:]               # a near copy with 20 words of its own
    quote = edited[135:165]
    rows = [(0, " ".join(line), "en", "a"), (1, " ".join(edited) + "\n" + " ".join(words(rng, 30)), "en", "a"),
            (2, " ".join(words(rng, 200) + quote + words(rng, 100)), "en", "a")]
    out = {r[0]: r[1] for r in substrings.remove_passages(make_docs(rows)).collect()}
    assert len(out[1].split()) == 30 and out[2] == rows[2][1] and not stands(rows, out.values())


def test_a_block_linked_through_its_own_line_stays(spark, make_docs):
    rng = random.Random(12)
    line = words(rng, 150)
    near = list(line)
    for at in (30, 80, 120):                             # Jaccard 0.81 with the first line
        near[at] = f"edit{at}"
    extra = " ".join(words(rng, 30))                     # the block is 0.8 like its line, but not the first
    rows = [(0, " ".join(line), "en", "a"), (1, " ".join(near) + "\n" + extra, "en", "a")]
    out = {r[0]: r[1] for r in substrings.remove_passages(make_docs(rows)).collect()}
    assert out[0] == rows[0][1] and out[1] == extra


def test_overlapping_passages_each_stand_somewhere(spark, make_docs):
    rng = random.Random(13)
    x, y, z = (words(rng, 30) for _ in range(3))
    pad = lambda: words(rng, 40)
    rows = [(1, " ".join(pad() + x + pad()), "en", "a"), (5, " ".join(pad() + x + y + pad()), "en", "a"),
            (9, " ".join(pad() + x + y + z + pad()), "en", "a"), (12, " ".join(pad() + y + z + pad()), "en", "a")]
    out = {r[0]: r[1] for r in substrings.remove_passages(make_docs(rows)).collect()}
    assert not stands(rows, out.values())
    assert sum(len(t.split()) for t in out.values()) < sum(len(r[1].split()) for r in rows) - 80


def test_no_shared_window_is_lost_in_a_corpus(spark, make_docs, edge_rows):
    """Repeats of every kind (lines, blocks, passages, whole copies, in long texts
    too): each window that is taken out of a live place stands somewhere."""
    rng = random.Random(14)
    pieces = [words(rng, rng.randint(20, 90)) for _ in range(25)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += rng.choice(pieces) if rng.random() < 0.5 else words(rng, rng.randint(3, 50))
            parts.append(rng.choice(["\n", "\n \n", ""]))
        rows.append((i, " ".join(p for p in parts if p), "en", "a"))
    rows += [(200, rows[7][1], "en", "a"), (None, rows[8][1], "fr", None), rows[9], rows[9]] + edge_rows[-12:]
    docs = make_docs(rows)
    out = substrings.remove_passages(docs)
    left = [(r[0], r[1]) for r in out.collect()]
    assert out.columns == docs.columns
    windows = {w for _, t in left for w in windows_of(t)}
    taken = 0
    for r in substrings.removals(substrings.identified(docs)).collect():
        texts = [t.split() for i, t, *_ in rows if i == r.doc_id and t]
        for start in r.w_gone or []:
            taken += 1
            assert any(tuple(w[start:start + 20]) in windows for w in texts)
    assert taken > 500
    assert left.count((9, next(t for i, t in left if i == 9))) == sum(r[0] == 9 for r in rows)
    assert any(t is None for _, t in left) and ("" in [t for _, t in left])


def test_near_copies_are_not_compared_all_with_all(spark):
    from pyspark.sql import functions as F
    from wideflow.llm.components import connected_components
    rng, sets, members = random.Random(12), {}, []
    for i in range(300):                                  # every third is too far from all others
        own = set(range(90))
        for j in rng.sample(sorted(own), 17 if i % 3 == 0 else rng.randint(2, 9)):
            own.remove(j)
            own.add(1000 * (i + 1) + j if j % 4 else 500 + j)
        sets[i] = own
        members.append((1, i))
    for i in range(300, 312):                             # a few in buckets of their own, of other sizes
        sets[i] = set(range(10_000, 10_000 + 20 + 2 * i - 600))
        members += [(2, i), (3 + i % 2, i), (5, i)] + [(1, i)] * (i == 305)
    near = lambda a, b: len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b])
    bucket = {}
    for b, i in members:
        bucket.setdefault(b, []).append(i)
    links = {(a, b) for m in bucket.values() for a in m for b in m if a < b and near(a, b)}
    m = substrings.stored(spark.createDataFrame([(b, i, len(sets[i])) for b, i in members], "bucket long, node long, z int"))
    s = substrings.stored(spark.createDataFrame([(i, list(x)) for i, x in sets.items()], "node long, sh array<long>"))
    seen = []

    def verified(pairs):
        got = [(r.a, r.b) for r in pairs.collect()]
        seen.extend(got)
        return spark.createDataFrame([(a, b) for a, b in got if near(a, b)], "a long, b long")

    found = substrings.paragraph_links(m, s, verified)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} <= links
    of = lambda d: {(r.node, r.component) for r in connected_components(d).collect()}
    all_links = spark.createDataFrame(sorted(links), "a long, b long")
    assert of(found) == of(all_links) and all_links.where(F.col("a") < 300).count() > 1000
    assert len(seen) < len(sets) ** 2 / 16                # a third with all others: three times as many or more
