"""Operators 6, 7 and 10, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, components, decontaminate, near_duplicates, near_sets, packed, substring_dedup
from tests.llm.helpers import WORD, documents, odd_rows, prose, words, write_tables


def windows(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows, threshold=0.8):
    sets = [windows(t) for _, t in rows]
    links = [0] * len(rows)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i is None, i or 0), least.get(root(k)) if links[k] else i, links[k]) for k, (i, _) in enumerate(rows))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.mark.parametrize(("block", "small"), [(512, 32), (7, 32), (7, 3)])
def test_near_duplicates(spark, monkeypatch, block, small):
    monkeypatch.setattr(near_sets, "BLOCK_SETS", block)
    monkeypatch.setattr(near_sets, "SMALL", small)
    rng = random.Random(12)
    base = prose(rng, 14)
    rows = [(i, t) for i, t, _, _ in odd_rows()]
    rows += [(100 + k, edited(rng, base, rng.randint(0, 6))) for k in range(60)] + [(300 + k, base) for k in range(20)] + [(400 + k, prose(rng, 5)) for k in range(40)]
    got = near_duplicates.near_duplicates(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links) for r in got) == brute_links(rows)


def test_bayesian_pruning_keeps_what_reaches_the_threshold():
    n = near_sets.tune(0.8, 0.99999, 5)
    assert 1 - (1 - 0.8**5) ** n >= 0.99999 > 1 - (1 - 0.8**5) ** (n - 1)
    for n in (15, 75, 150):
        m = near_sets.least_matches(n, 0.8, near_sets.TOLERANCE)
        assert 0 < m < 0.8 * n
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in rng.integers(0, 120, 60)]
    starts = np.cumsum([0, *map(len, sets)])
    sig = near_sets.minhash(np.concatenate(sets), starts[:-1], 150)
    p, q = near_sets.similar_pairs(sig, sets, sig, sets, 0.8, True)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == {(a, b) for a in range(60) for b in range(a + 1, 60) if jaccard(sets[a], sets[b]) >= 0.8}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(5, 5)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert {r.id: r.root for r in got} == {x: root(x) for x in group} and len(got) == len(group)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [2048, 0])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(packed, "HOT_ROWS", hot)
    rng = random.Random(7)
    passage, other = prose(rng, 8), prose(rng, 8)
    line = words(rng, 30).capitalize() + "."
    clean = [prose(rng, 6) + "\n" + line + "\n" + prose(rng, 5) for _ in range(20)]
    holders = {
        50: prose(rng, 4) + " and so " + passage + " then " + prose(rng, 4), 51: words(rng, 12) + " " + passage + " " + words(rng, 30), 52: prose(rng, 3) + "\n" + passage + "\n" + prose(rng, 3),
        60: prose(rng, 3) + " " + other + " " + prose(rng, 2), 61: prose(rng, 3) + " " + edited(rng, other, 2) + " " + prose(rng, 2), 70: passage,
    }
    rows = [(i, t, None, None) for i, t in enumerate(clean)] + [(i, t, None, None) for i, t in holders.items()] + [(900, None, None, None), (901, "", None, None), (None, passage, None, None), (902, "x. " * 2, None, None)]
    rows += [(50, prose(rng, 9), None, None), (51, prose(rng, 9), None, None), (None, prose(rng, 9), None, None), (903, (words(rng, 20) + " ") * 4, None, None)]
    docs = documents(spark, rows)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {*holders, None}
    assert {r.doc_id for r in found if r.removed} == {51, 52, 61, 70, None}
    assert len({r.class_id for r in found}) == 2 and {r.first_id for r in found if r.removed} == {50, 60}
    for r in found:
        span = next(s for i, t, _, _ in rows if i == r.doc_id and t is not None and (s := t.encode()[r.start : r.end].decode()) in (passage if r.doc_id not in (60, 61) else t))
        assert len(WORD.findall(span)) == r.n_words >= 50
        assert r.doc_id in (60, 61) or span == passage
    cut = substring_dedup.remove(docs, substring_dedup.repeated_passages(docs)).collect()
    # rows without a passage of their own are whole, whatever their ids; a row that is one passage goes
    gone = [(i, t) for i, t, _, _ in rows if t == passage]
    left = [(i, t.replace(passage, "") if i in (51, 52) else t) for i, t, _, _ in rows if (i, t) not in gone and i != 61]
    show = lambda x: sorted((i or -1, t or "", t is None) for i, t in x)
    assert show((r.doc_id, r.text) for r in cut if r.doc_id != 61) == show(left)
    assert len(cut) == len(rows) - len(gone) and cut[0].key == "x" and list(cut[0].asDict()) == docs.columns


def shared_passages(rows, n=50):
    """The ids of documents that share n successive words with a document of other id or text, by brute force."""
    holders = {}
    for k, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        for i in range(len(w) - n + 1):
            holders.setdefault(tuple(w[i : i + n]), set()).add(k)
    return {k for found in holders.values() if len({rows[x] for x in found}) > 1 for k in found}


def test_substrings_find_every_repeat_of_fifty_words(spark):
    """Passages of 50 to 60 words, some without any full stop, at any place of other texts; shorter ones are left alone."""
    rng = random.Random(21)
    rows = []
    for k in range(60):
        passage = words(rng, rng.randint(50, 60)) if k % 2 else " ".join(prose(rng, 9).split(" ")[: rng.randint(50, 60)])
        short = " ".join(passage.split(" ")[: rng.randint(30, 44)])
        glue = lambda n: words(rng, rng.randint(0, n))
        rows += [(3 * k, f"{glue(30)} {passage} {glue(30)}"), (3 * k + 1, f"{glue(90)}\n{passage} {glue(30)}"), (3 * k + 2, f"{glue(9)} {short}. {glue(30)}")]
    want = {rows[k][0] for k in shared_passages(rows)}
    got = substring_dedup.repeated_passages(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r.doc_id for r in got} == want and len(want) == 120
    assert {r.doc_id for r in got if r.removed} == {i for i in want if i % 3 == 1}


def test_substrings_find_edited_passages(spark):
    """Three sentences of twenty words, one word of the middle one changed: Jaccard 51 / 61."""
    rng = random.Random(22)
    rows, n = [], 40
    for k in range(n):
        w = words(rng, 60).split(" ")
        w[19], w[39], w[59] = w[19] + ".", w[39] + ".", w[59] + "."
        rows.append((2 * k, prose(rng, 3) + "\n" + " ".join(w) + "\n" + prose(rng, 3)))
        w[rng.randrange(24, 36)] = "changed"
        rows.append((2 * k + 1, prose(rng, 3) + "\n" + " ".join(w) + "\n" + prose(rng, 3)))
    got = substring_dedup.repeated_passages(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert len({r.doc_id for r in got}) >= 0.95 * len(rows)


@pytest.mark.parametrize("hot", [2048, 0])
def test_substrings_beyond_the_first_document_of_a_paragraph(spark, monkeypatch, hot):
    """The first document has all short paragraphs of a passage, at several places, but no fifty words of it in a row; two or three later ones share the passage, or different parts of it."""
    monkeypatch.setattr(packed, "HOT_ROWS", hot)
    rng = random.Random(31)
    rows, glue = [], lambda: words(rng, 30)
    line = words(rng, 14)
    for k in range(25):
        w = words(rng, rng.randint(55, 110)).split(" ")
        parts = [" ".join(w[i : i + 44]) for i in range(0, len(w), 7)]
        rows += [(10 * k, " ".join(f"{part} {glue()}" for part in parts)), (10 * k + 1, f"{glue()} {' '.join(w)} {glue()}"), (10 * k + 2, f"{glue()} {' '.join(w)} {glue()}")]
        rows += [(10 * k + 3, f"{glue()} {' '.join(w[:52])} {glue()}"), (10 * k + 4, f"{glue()} {' '.join(w[-51:])} {glue()}")]
        # a line that all have, in surroundings that two of them share
        both = f"{words(rng, 20)} {line} {words(rng, 18)}"
        rows += [(10 * k + n, f"{glue()}\n{both if n > 6 else line}\n{glue()}") for n in (5, 6, 7, 8)]
    want = {rows[k][0] for k in shared_passages(rows)}
    got = substring_dedup.repeated_passages(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r.doc_id for r in got} == want and {i % 10 for i in want} == {1, 2, 3, 4, 7, 8}
    assert {r.doc_id for r in got if r.removed} == {i for i in want if i % 10 in (2, 3, 4, 8)}
    assert all(r.n_words >= 52 for r in got if r.doc_id % 10 == 8) and len({r.class_id for r in got}) == 50


def test_substrings_find_edited_passages_among_others_alike(spark):
    """Two paragraphs of sixty words that differ in one word, after thirty others that differ from them in two words or more (Jaccard 0.7 at most)."""
    rng = random.Random(32)
    rows, n = [], 8

    def changed(w, *at):
        return " ".join(f"changed{rng.randrange(10**9)}" if i in at else x for i, x in enumerate(w))

    for k in range(n):
        w = words(rng, 60).split(" ")
        for m in range(30):
            rows.append((100 * k + m, f"{words(rng, 50)}\n{changed(w, rng.randint(12, 25), rng.randint(34, 47))}\n{words(rng, 50)}"))
        rows += [(100 * k + 50 + m, f"{words(rng, 50)}\n{changed(w, *at)}\n{words(rng, 50)}") for m, at in enumerate(((), (30,)))]
    got = substring_dedup.repeated_passages(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r.doc_id for r in got} == {100 * k + 50 + m for k in range(n) for m in (0, 1)}
    assert {r.doc_id for r in got if r.removed} == {100 * k + 51 for k in range(n)} and len({r.class_id for r in got}) == n


def test_substrings_in_runs_of_a_word_pair(spark, monkeypatch):
    """A pair of words repeated for hundreds of words makes a paragraph every other word; documents that hold it are tied once for each run, not for each paragraph, and all runs are found whole."""
    rng = random.Random(33)
    ties, written = [], common.written

    def counted(df, name):
        out = written(df, name)
        if name == "paragraph-ties":
            ties.append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    pair, n = words(rng, 2), 20
    # the first document has the pair for fewer words, and two documents have two runs
    rows = [(0, f"{words(rng, 40)} {' '.join([pair] * 20)} {words(rng, 40)}")]
    runs = lambda k: [100] * (2 if k in (5, 6) else 1)
    rows += [(k, f"{words(rng, 40)} " + " ".join(f"{' '.join([pair] * m)} {words(rng, 90)}" for m in runs(k))) for k in range(1, n + 1)]
    got = substring_dedup.repeated_passages(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sum(ties) <= 8 * n
    for k in range(2, n + 1):
        found = [r for r in got if r.doc_id == k and r.removed]
        assert [r.n_words >= 200 for r in found] == [True] * len(runs(k))
    assert not [r for r in got if r.doc_id == 1 and r.removed]


def brute_similarity(item, text):
    a, b = [[w.lower() for w in WORD.findall(x or "")] for x in (item, text)]
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        now = [0.0]
        for j, y in enumerate(b, 1):
            now.append(max(0.0, above[j - 1] + (1 if x == y else -0.5), above[j] - 0.5, now[-1] - 0.5))
        best, above = max(best, max(now)), now
    return best / len(a) if a else 0.0


def test_decontamination(spark):
    rng = random.Random(10)
    items = [(k, words(rng, rng.randint(15, 50))) for k in range(12)] + [(50, None), (51, "  "), (52, "two words"), (3, "repeat of an id with some more words in it")]
    rows = []
    for k in range(40):
        text = prose(rng, 6)
        if k % 2:
            own = rng.choice(items[:12])[1].split(" ")
            for _ in range(rng.randint(0, len(own) // 5)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [words(rng, 1)], [own[at], words(rng, 1)]])
            text = text + " " + " ".join(own).upper() + " " + prose(rng, 6)
        rows.append((k, text, None, None))
    rows += [(90, None, None, None), (91, "", None, None), (92, "say two words here", None, None), (None, items[0][1], None, None), (93, " ".join([items[1][1]] * 300), None, None)]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    assert sorted(r.item_id for r in decontaminate.left_out(bench).collect()) == [50, 51, 52]
    for i, t, _, _ in rows:
        for k, x in items:
            if len(WORD.findall(x or "")) >= decontaminate.LEAST_WORDS and (s := brute_similarity(x, t)) >= 0.6:
                want[i, k] = max(want.get((i, k), 0), s)
    for size in (20_000, 5):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench, block_items=size).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = [r.doc_id for r in decontaminate.clean(docs, bench).collect()]
    assert sorted(kept) == sorted(i for i, *_ in rows if i is not None and i not in {d for d, _ in want})


def test_decontamination_finds_every_edited_copy(spark):
    """Each copy once and nowhere exact: a quarter of the words changed, every 6th changed, a word put in after every second one."""
    rng = random.Random(11)
    items = [(k, words(rng, rng.choice((5, 8, 15, 40, 60)))) for k in range(90)]
    rows = []
    for k, text in items:
        own = text.split(" ")
        if k % 3 == 0:
            for at in rng.sample(range(len(own)), len(own) // 4):
                own[at] = "changed" + str(at)
        elif k % 3 == 1:
            own[5::6] = ["other" + str(at) for at in range(len(own[5::6]))]
        else:
            own = [x for at, w in enumerate(own) for x in ([w, "in" + str(at)] if at % 2 else [w])]
        rows.append((k, prose(rng, 4) + " " + " ".join(own) + " " + prose(rng, 4), None, None))
    want = {(i, k): s for i, t, _, _ in rows for k, x in items if (s := brute_similarity(x, t)) >= 0.6}
    assert len({i for i, _ in want}) >= 80
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i, *_ in rows} - {i for i, _ in want}


def test_near_copies_go_by_row(spark):
    """Null and repeated ids: of each class one row stays, whatever else has its id."""
    rng = random.Random(16)
    a, b, c, d = (prose(rng, 30) for _ in range(4))
    alone = [prose(rng, 12) for _ in range(4)]
    near = a.rsplit(" ", 1)[0] + " end."
    rows = [(1, a), (None, near), (None, alone[0]), (None, alone[1]), (2, b), (20, b), (20, alone[2]), (20, alone[2]), (None, c), (None, c), (None, c.rsplit(" ", 1)[0] + " end."), (30, d), (30, d.rsplit(" ", 1)[0] + " end."), (40, alone[3])]
    docs = documents(spark, [(i, t, "en", "s1") for i, t in rows])
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text[:40]) for r in kept.collect())
    assert got == sorted((i or 0, t[:40]) for i, t in [(1, a), (None, alone[0]), (None, alone[1]), (2, b), (20, alone[2]), (None, c), (30, d), (40, alone[3])])


def test_pipeline(spark):
    rng = random.Random(15)
    item, passage = words(rng, 40), prose(rng, 8)
    rows = odd_rows() + [(200 + k, prose(rng, 9), "en", "s1") for k in range(12)]
    rows += [(300, prose(rng, 5) + " " + item + " " + prose(rng, 5), "en", "s2"), (301, prose(rng, 9) + " " + passage, "en", "s2"), (302, prose(rng, 9) + " " + passage, "en", "s2")]
    folder = common.work_path(spark, "pipeline-test")
    docs = documents(spark, rows)
    write_tables(spark, folder, docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "mixing"]
    ids, kept = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, kept, folder), "stage")
        assert kept.columns == docs.columns
        ids.append(sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()))
    drop = lambda a, b: [x for x in a if x not in b]
    every = sorted((i is None, i or 0) for i, *_ in rows)
    assert [x[1] for x in drop(every, ids[0])] == [5, 6, 7, 13]
    assert {x[1] for x in drop(ids[0], ids[1])} == {2, 3, 0} and ids[1].count((False, 10)) == 1
    assert ids[2] == ids[1] and drop(ids[2], ids[3]) == [(False, 300)]
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert passage[-60:] in texts[301][0] and passage[-60:] not in texts[302][0] and texts[302][1] == len(texts[302][0])
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "position"] and out.count() == len(ids[3])
    assert out.agg(F.sum("taken")).first()[0] == pytest.approx(out.agg(F.sum("size")).first()[0], abs=4)


def test_operators_6_and_7_on_documents(spark):
    """The whole table of a thousand documents: all links, and every document with fifty words in a row that another one has."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = near_duplicates.op6_ngram_jaccard_join(spark, folder).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links) for r in got) == brute_links(rows)
    found = substring_dedup.op7_substring_dedup(spark, folder).collect()
    shared = {rows[k][0] for k in shared_passages(rows)}
    # nothing else goes but near copies of what an earlier document has
    texts = dict(rows)
    assert shared <= {r.doc_id for r in found}
    for r in found:
        if r.removed:
            own = windows(texts[r.doc_id].encode()[r.start : r.end].decode())
            assert len(own & windows(texts[r.first_id])) >= 0.8 * len(own) and r.n_words >= 50 and r.first_id < r.doc_id
