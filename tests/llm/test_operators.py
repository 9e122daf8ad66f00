"""Operators 1, 2, 3, 5, 8 and 9 against brute force, on odd rows and on held-out rows."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, language, mixing, ngram_lm, quality, token_counts, url_filter
from quillon.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.helpers import WORD, documents, odd_rows, prose, words, write_tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    path = common.work_path(spark, "test-tables")
    write_tables(spark, path, documents(spark, odd_rows()))
    return path


@pytest.fixture(scope="module")
def empty(spark):
    path = common.work_path(spark, "test-empty")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_tables(spark, path, documents(spark, []), pages, spark.createDataFrame([], "item_id long, text string"))
    return path


def by_row(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names], strict=True)))
    assert rows(got) == rows(want)


def test_token_counts(spark, folder):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [(i, t or "") for i, t, _, _ in odd_rows()]
    want = sorted(((i is None, i or 0), len(t.encode()), len(own.encode(t))) for i, t in texts)
    got = QUERIES["op1_token_counts"](spark, folder).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    # a cache that is used again encodes nothing, and keeps the versions of tokenizers apart
    cache, docs = common.work_path(spark, "cache"), common.table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = by_row(token_counts.token_counts(docs, path, cache))
    size = spark.read.parquet(cache).count()
    assert size == len({t for _, t in texts})
    assert by_row(token_counts.token_counts(docs, path, cache)) == first and spark.read.parquet(cache).count() == size
    token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache).count()
    assert spark.read.parquet(cache).count() == 2 * size
    t = Tokenizer.from_file(path)
    assert sorted(r["n_tokens"] for r in first) == sorted(len(t.encode(x, add_special_tokens=False).ids) for _, x in texts)


def brute_ngrams(train, tests, order=2):
    """A plain modified Kneser-Ney model."""
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
    padded = lambda t: ["<s>"] * (order - 1) + [*low(t), "</s>"]
    uni, counts = Counter(), {order: Counter()}
    for t in train:
        s = padded(t)
        uni.update(s[order - 1 :])
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    n_all, v = sum(uni.values()), len(uni)
    disc = {k: ngram_lm.discounts([sum(1 for c in counts[k].values() if c == j) for j in (1, 2, 3, 4)]) for k in counts}
    total, kinds = Counter(), {}
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            kinds.setdefault((k, g[:-1]), [0, 0, 0, 0])[min(n, 3)] += 1

    def chance(g):
        k = len(g)
        lower = chance(g[1:]) if k > 1 else 1 / (v + 1)
        if (k, g[:-1]) not in kinds:
            return lower
        n = counts[k][g]
        left = sum(disc[k][j] * kinds[k, g[:-1]][j] for j in (1, 2, 3))
        return (max(n - disc[k][min(n, 3)], 0) + left * lower) / total[k, g[:-1]]

    out = []
    for t in tests:
        s = padded(t)
        words = s[order - 1 :]
        score = sum(math.log10(chance(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))
        out.append((len(words), sum(uni[w] > 0 for w in words), n_all, sum(math.log10((uni[w] + 1) / (n_all + v + 1)) for w in words), score))
    return out


def test_language_model(spark, folder):
    rows = odd_rows()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    want = brute_ngrams([r[1] for r, h in zip(rows, held, strict=True) if not h], [r[1] for r in rows])
    got = QUERIES["op2_lm_scoring"](spark, folder).collect()
    key = lambda x: tuple(round(y, 6) for y in x)
    assert sorted(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got) == sorted(map(key, want))
    assert sorted((r.doc_id or 0, r.held_out) for r in got) == sorted((r[0] or 0, h) for r, h in zip(rows, held, strict=True))


@pytest.mark.parametrize(("order", "flush", "shard_bytes"), [(2, 50, 200), (3, 1 << 20, 16 << 20), (3, 50, 200), (4, 50, 200)])
def test_orders_of_the_language_model(spark, monkeypatch, order, flush, shard_bytes):
    """Several shards, and tasks that send what they have several times."""
    monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", flush)
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", shard_bytes)
    rng = random.Random(order)
    texts = [*(prose(rng, 3) for _ in range(30)), None, "", "one", "One two", "a a a a a a", "a a a"]
    train, tests = texts + texts[:5], [*texts, "never seen before", prose(rng, 3)]
    of = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string").repartition(3)
    model = ngram_lm.train(of(train), common.work_path(spark, "lm"), order)
    key = lambda x: tuple(round(y, 6) for y in x)
    got = [key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in ngram_lm.score(of(tests), model, F.col("text")).collect()]
    assert sorted(got) == sorted(map(key, brute_ngrams(train, tests, order)))
    none = ngram_lm.train(of(train).filter("false"), common.work_path(spark, "lm"), order)
    assert ngram_lm.score(of(tests), none, F.col("text")).agg(F.sum("score")).first()[0] == 0


def test_language_model_sums_to_one_and_beats_base(spark):
    rng = random.Random(9)
    texts = [prose(rng, 3) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = ngram_lm.train(df, common.work_path(spark, "lm"))
    vocabulary = sorted({w.lower() for t in texts for w in WORD.findall(t)})
    single = spark.createDataFrame([(w,) for w in [*vocabulary, "neverseen"]], "text string")
    begin = {r.text: r.score for r in ngram_lm.score(single, model, F.col("text")).collect()}
    after = {}
    for w, s in begin.items():
        after[w] = s
    ends = ngram_lm.score(spark.createDataFrame([("",)], "text string"), model, F.col("text")).first().score
    # P(w | begin) = P(w, end | begin) / P(end | w); summed with the end and one unknown word it is 1
    doubled = {r.text: r.score for r in ngram_lm.score(spark.createDataFrame([(f"{w} {w}",) for w in begin], "text string"), model, F.col("text")).collect()}
    assert all(doubled[f"{w} {w}"] < begin[w] for w in begin) and ends < 0
    held = spark.createDataFrame([(prose(rng, 3),) for _ in range(20)], "text string")
    r = ngram_lm.score(held, model).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
    none = ngram_lm.train(df.filter("false"), common.work_path(spark, "lm"))
    assert ngram_lm.score(held, none).agg(F.sum("score")).first()[0] == 0


def test_language_id(spark, folder):
    rng = random.Random(2)
    rows = [(i, prose(rng, 4, lang), lang, "s") for i, lang in enumerate(["en", "es", "fr"] * 60)]
    out = by_row(language.identify(documents(spark, rows)))
    assert all(r["lang_pred"] == lang for r, (_, _, lang, _) in zip(out, rows, strict=True) if r["held_out"])
    assert sum(r["held_out"] for r in out) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows)
    odd = by_row(QUERIES["op3_language_id"](spark, folder))
    assert len(odd) == len(odd_rows())
    for r in odd:
        text = {i: t for i, t, _, _ in odd_rows()}[r["doc_id"]]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text)), r
    # labels and ids of what is predicted play no part
    swapped = documents(spark, [(i, t, "es" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows])
    assert [r["lang_pred"] for r in by_row(language.identify(swapped))] == [r["lang_pred"] for r in out]
    nothing = documents(spark, [(1, "abc", None, "s"), (2, None, "en", "s")])
    assert {r["lang_pred"] for r in by_row(language.identify(nothing))} == {"und"}
    one = documents(spark, [(1, "abc def", "en", "s"), (2, "ghi", None, "s")])
    assert {r["lang_pred"] for r in by_row(language.identify(one))} == {"en"}


def test_many_languages_get_far_codewords():
    codes = language.codewords(30)
    assert codes.shape[0] == 30 and min((codes[i] != codes[j]).sum() for i in range(30) for j in range(i)) >= 10
    assert language.codewords(4).shape == (4, 7)


def brute_quality(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark):
    rng = random.Random(5)
    texts = [t for _, t, _, _ in odd_rows()] + ["a b c d e f g h i j a b c d e k", "l1 x\nl1 x\n\nl2\nl1 x", "w " * 30, "x y " * 4000, "# $ a | b\x0bc", prose(rng, 20) + "\n" + prose(rng, 3)]
    df = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = by_row(quality.quality(df))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(r[n] for n in names) for r in got] == [brute_quality(t) for t in texts]
    assert all(r["kept"] <= (not r["base_failed"]) and r["kept"] == (r["failed_rule"] is None) for r in got)
    # the order of the rules doesn't change the verdict, and a filter on the result gives its rows
    turned = by_row(quality.quality(df, quality.default_rules()[::-1]))
    assert [r["kept"] for r in turned] == [r["kept"] for r in got]
    assert quality.quality(df).filter("kept").count() == sum(r["kept"] for r in got)


def test_cascade_order(spark):
    rng = random.Random(6)
    df = documents(spark, [(i, prose(rng, 30) if i % 4 else prose(rng, 6).upper(), None, None) for i in range(400)])
    rules = {r.name: r for r in quality.default_rules()}
    order = quality.plan_cascade(df, [rules["few_bullets"], rules["not_shouting"]])
    assert [r.name for r, _, _ in order] == ["not_shouting", "few_bullets"] and abs(order[0][2] - 0.25) < 0.01


def test_url_rules(spark):
    urls = [
        "http://a.net/x", "https://example.net/en/1", "https://www.Example.NET/en/", "http://example.net/EN/1", "http://example.net", "http://notexample.net/en/x", "http://example.com/de/?q=1", "http://x.org/fr/#a",
        "http://x.org/fr", "no scheme", None, "", "ftp://b.example.com/de/a?x=http://c.net/", "http://a.net?x/y", "//a.net/", "http://é.com/ü", "http://a.net/" + "p" * 3000,
    ]
    pages = spark.createDataFrame([(i, u, "h", 0.5) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = by_row(url_filter.judge(pages, url_filter.RULES), "page_id")

    def brute(u):
        head, sep, rest = (u or "").partition("://")
        if not sep:
            return "", "", None
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fit, key=lambda r: len(r.text)).text if fit else None

    assert [(r["host"], r["path"], r["rule"]) for r in got] == [brute(u) for u in urls]
    verdicts = {r.text: r.verdict for r in url_filter.RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"]) and {r["verdict"] for r in got} <= {"allow", "block"}


def test_url_trees_learn(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        path = "".join(rng.choice("0123456789") for _ in range(rng.randint(8, 20))) if bad else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 12)))
        rows.append((i, f"http://h{rng.randint(0, 400)}.example.com/{path}" + ("?a=1&b=2" if rng.random() < 0.3 else ""), "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df.filter("page_id >= 1000"), (), df.filter("page_id < 1000")).collect()}
    assert len(got) == 500 and sum(got[i] == y for i, _, y in rows[1000:]) >= 480
    none = url_filter.judge(df.limit(3), (), df.filter("false"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    blocked = url_filter.judge(df.limit(3), (), df.filter("label = 'block'"))
    assert {r.verdict for r in blocked.collect()} == {"block"}


def water_fill(sizes, weights, most=3):
    fixed, total = set(), sum(sizes)
    while True:
        rest = total - sum(most * sizes[k] for k in fixed)
        w = sum(weights[k] for k in range(len(sizes)) if k not in fixed)
        t = [most * sizes[k] if k in fixed else rest * weights[k] / w for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if k not in fixed and t[k] > most * sizes[k] + 1e-9}
        if not over:
            return t
        fixed |= over


def test_mixing(spark, folder):
    got = by_row(mixing.mix(common.table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "position"))
    sources = sorted({r["source"] for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in sources]
    want = water_fill(sizes, [k % 3 + 1 for k in range(len(sources))])
    for s, size, target in zip(sources, sizes, want, strict=True):
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(WORD.findall({i: t for i, t, _, _ in odd_rows()}[r["doc_id"]] or "")) for r in got)
    assert all((r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1) for r in got)
    again = by_row(mixing.mix(common.table(spark, folder, "documents").repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken", "position"))
    assert again == got


def test_curriculum_follows_its_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, "w " * 10, None, "abc"[i % 3]) for i in range(3000)]
    order = mixing.training_order(mixing.mix(documents(spark, rows))).collect()
    positions = [r.position for r in order]
    assert positions == sorted(positions) and sum(r.words for r in order) == 30_000
    late = {s: sum(r.position > 0.5 for r in order if r.source == s) / sum(r.source == s for r in order) for s in "abc"}
    # the integrals of the three schedules over the second half
    assert abs(late["a"] - 0.5) < 0.02 and abs(late["b"] - 0.7) < 0.02 and abs(late["c"] - 0.285) < 0.03


def test_mixing_by_brute_force(spark, monkeypatch):
    """Each row's taken words and position: prefix sums in the order of the hash, and the schedule's integral inverted by bisection."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng = random.Random(13)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(5, "w w", None, "a"), (None, "w " * 9, None, "b"), (400, None, None, "e")]
    df = documents(spark, rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.size), r.taken, r.position) for r in mixing.mix(df).collect())
    hashed = [(r.id, r.source, r.size, r.h) for r in df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size")).withColumn("h", F.xxhash64("id", "size")).collect()]
    sources = sorted({s for _, s, _, _ in hashed}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n, _ in hashed if s == x) for x in sources]
    want = []
    for rank, (source, size, target) in enumerate(zip(sources, sizes, water_fill(sizes, [k % 3 + 1 for k in range(len(sources))]), strict=True)):
        knots = mixing.SCHEDULES[rank % 3]

        def integral(t, knots=knots):
            area = 0.0
            for (a, v), (b, w) in zip(knots, knots[1:], strict=False):
                x = min(max(t, a), b)
                area += (x - a) * (v + (v + (w - v) * (x - a) / (b - a))) / 2
            return area

        place = 0
        for i, s, n, _ in sorted((x for x in hashed if x[1] == source), key=lambda x: (x[3], x[0] or 0, x[2])):
            whole = int(target // size) if size else 0
            taken = whole * n + min(max(round(target - whole * size) - place, 0), n)
            low, high = 0.0, 1.0
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if size and integral(middle) < place / target * integral(1) else (low, middle)
            want.append(((i is None, i or 0, n), taken, high if taken else None))
            place += n
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda x: x[0]), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-6)


def test_language_decoding_by_brute_force(spark):
    """Counting, bit weights and loss-weighted decoding again, in plain loops over n-grams."""
    rng = random.Random(14)
    rows = [(i, prose(rng, 1, lang).replace(" ", ", ", 1) + (" É—Ü 12" if i % 3 else ""), lang, "s") for i, lang in enumerate(["en", "es", "fr"] * 12)]
    docs = documents(spark, rows)
    model = language.fit(docs)

    def cells(text):
        folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        out = []
        for word in folded.split(b" "):
            for at in range(len(word)):
                code = word[at] + 1
                for k in range(1, 5):
                    if at + k > len(word) + 1:
                        break
                    if k > 1:
                        code = (code * 0x01000193 % 2**32) ^ ((word + b" ")[at + k - 1] + (k << 9))
                    h = code * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                    out.append(max((h * 0x85EBCA77 % 2**32) >> 19, 1))
        return out

    languages = sorted({lang for _, _, lang, _ in rows})
    counts = {x: Counter(c for _, t, lang, _ in rows if lang == x for c in cells(t)) for x in languages}
    share = {x: [(counts[x][c] + 0.5) / (sum(counts[x].values()) + 0.5 * language.CELLS) for c in range(language.CELLS)] for x in languages}
    bits = language.codewords(len(languages)).T.tolist()

    def weight(bit, c):
        group = lambda b: [share[x][c] for x, y in zip(languages, bit, strict=True) if y == b]
        return 0.0 if c == 0 else math.log(sum(group(1)) / len(group(1))) - math.log(sum(group(0)) / len(group(0)))

    weights = [[weight(bit, c) for c in range(language.CELLS)] for bit in bits]
    means = [[sum(share[x][c] * w[c] for c in range(language.CELLS)) for x in languages] for w in weights]
    centre, scale, votes = [], [], []
    for bit, mean in zip(bits, means, strict=True):
        low, high = ([m for m, b in zip(mean, bit, strict=True) if b == y] for y in (0, 1))
        centre.append((max(low) + min(high)) / 2)
        scale.append(max((sum(high) / len(high) - sum(low) / len(low)) / 2, 1e-6))
        votes.append(max((min(high) - max(low)) / (2 * scale[-1]), 0.05))
    votes = [v / sum(votes) * len(votes) for v in votes]
    tests = [(900 + i, prose(rng, 1, lang)) for i, lang in enumerate(["en", "es", "fr"] * 4)] + [(950, "x"), (951, "the ción eau"), (952, "É")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(documents(spark, [(i, t, None, None) for i, t in tests]), model, F.col("doc_id")).collect()}
    for i, text in tests:
        own = cells(text)
        loss = dict.fromkeys(languages, 0.0)
        for bit, w, m, s, v in zip(bits, weights, centre, scale, votes, strict=True):
            f = (sum(w[c] for c in own) / max(len(own), 1) - m) / s * math.sqrt(min(len(own), 400) / 400) * 4
            for x, y in zip(languages, bit, strict=True):
                loss[x] += v * math.log1p(math.exp(-f if y else f))
        best = min(languages, key=loss.get)
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(math.exp(loss[best] - loss[x]) for x in languages)) < 1e-4


def test_boosted_trees_by_brute_force(spark):
    """Every split of every node tried by hand on all rows."""
    rng = random.Random(15)
    n = len(url_filter.FEATURES)
    rows = [[float(rng.randint(0, 6)) for _ in range(n)] for _ in range(400)]
    labels = [float((r[1] + r[3] > 6) != (rng.random() < 0.1)) for r in rows]
    df = spark.createDataFrame([(y, *r) for y, r in zip(labels, rows, strict=True)], "y double, " + ", ".join(f"{f} double" for f in url_filter.FEATURES))
    model = url_filter.train(df, n_trees=3, depth=2)
    got = [r[0] for r in df.select(model.margin().alias("m"), F.monotonically_increasing_id().alias("k")).orderBy("k").collect()]
    rate = min(max((sum(labels) + 0.5) / 401, 1e-3), 1 - 1e-3)
    margin = [math.log(rate / (1 - rate))] * 400
    for _ in range(3):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - y for a, y in zip(p, labels, strict=True)], [a * (1 - a) for a in p]
        leaves = [(list(range(400)), 0.0)]
        for _ in range(2):
            following = []
            for own, value in leaves:
                part = lambda ks: (sum(g[k] for k in ks), sum(h[k] for k in ks))
                gain = lambda ks: part(ks)[0] ** 2 / (part(ks)[1] + 1)
                best = (1e-3, None, None)
                for f in range(n):
                    for cut in range(6):
                        low, high = [k for k in own if rows[k][f] <= cut], [k for k in own if rows[k][f] > cut]
                        if low and high and gain(low) + gain(high) - gain(own) > best[0] + 1e-9:
                            best = (gain(low) + gain(high) - gain(own), low, high)
                following += [(own, value)] if best[1] is None else [(x, -0.4 * part(x)[0] / (part(x)[1] + 1)) for x in best[1:]]
            leaves = following
        for own, value in leaves:
            for k in own:
                margin[k] += value
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, margin, strict=True))


def test_a_text_of_twenty_megabytes(spark):
    """Read whole by the operators on texts, beside short ones."""
    rng = random.Random(17)
    some = [words(rng, 1) for _ in range(20_000)]
    long = " ".join(rng.choices(some, k=3_000_000))
    long = (long + " end" * 20)[: 20 << 20]
    item = " ".join(rng.choices(some, k=40))
    at = long.index(" ", len(long) // 2)
    long = long[:at] + " " + item + long[at:]
    near = long[: len(long) - 2000]
    path = common.work_path(spark, "long-texts")
    docs = documents(spark, [(1, long, "en", "s"), (2, near, "en", "s"), (3, prose(rng, 20), "en", "s"), (5, None, "en", "s")], extra=False)
    write_tables(spark, path, docs, benchmark=spark.createDataFrame([(7, item)], "item_id long, text string"))
    n = len(WORD.findall(long))
    assert {r.doc_id: r.n_tokens for r in QUERIES["op2_lm_scoring"](spark, path).collect()}[1] == n + 1
    assert {r.doc_id: r.n_bytes for r in QUERIES["op1_token_counts"](spark, path).collect()}[1] == len(long.encode())
    assert {r.doc_id: r.lang_pred for r in QUERIES["op3_language_id"](spark, path).collect()}[1] in ("en", "und")
    assert {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op6_ngram_jaccard_join"](spark, path).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 5: (5, 0)}
    found = {(r.doc_id, r.removed): r.n_words for r in QUERIES["op7_substring_dedup"](spark, path).collect()}
    assert found[2, True] == len(WORD.findall(near)) and abs(found[1, False] - found[2, True]) <= 1
    assert sorted(r.doc_id for r in QUERIES["op10_decontamination"](spark, path).collect()) == [1, 2]
    assert {r.doc_id: r.size for r in QUERIES["op9_mixing"](spark, path).collect()}[1] == n
