"""The training-data operators against brute force on small tables, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
import public_tokenizers  # noqa: E402

from graphloom.llm import decontaminate, langmix, licenses, linestore, neardup, packing, quality, secrets, segment, textkit as tk, tokenbin  # noqa: E402

ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

LINE = "This line is boilerplate that a great many pages carry along."
VOCAB = [f"word{i}" for i in range(60)] + ["été", "Ünder", "naïve", "the", "The", "of"]


def corpus(seed: int = 1) -> list[tuple]:
    """Random prose with copies, near copies, shared lines, nulls, blanks, and one long text."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "two words", "three small words", "a b c d", "\t\x0b x \r\n y", "日本語のテキスト", "🎉 emoji▁here"]
    base = prose(120)
    texts += [base, base, base.upper(), base.replace(base.split()[50], "changed", 1), base + " tail", "head " + base]
    texts += [prose(80) + "\n" + LINE + "\n" + prose(20) for _ in range(7)] + [LINE + "\n" + "  " + LINE.lower() + "\t\n" + LINE]
    texts += [prose(r.randint(1, 200)) for _ in range(20)] + ["repeat me now " * 40, "\n".join(["same line"] * 30 + [prose(60)])]
    texts += [prose(20_000), "Released under the MIT License. " + prose(30), "password = hunter2hunter " + prose(5), "x" * 5000]
    for k in range(6):
        words = base.split()
        words[10 * k] = f"near{k}"
        texts.append(" ".join(words))
    rows = [(i * 3, t, "en" if i % 2 else "de", f"host{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[11], (None, base, "en", None, len(base)), (None, None, None, None, None)]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    if extra:  # columns whose names clash with those that the operators make
        for c in ("n_words", "kept", "h1", "sig", "shard", "slot", "size", "id", "component", "n_lines", "ids", "block", "key", "a", "b", "batch", "host", "items"):
            df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus(), True).repartition(3).cache()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text: str | None, k: int) -> frozenset:
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_textkit_blocks_and_spans():
    texts = pa.array(["ab  c", None, "", "日 x", " "])
    for limit in (1, 5, 1000):
        found = []
        for b in tk.blocks(texts, limit):
            s, e, o = b.spans(tk.NONSPACE[b.raw])
            found += [[b.raw[s[k] : e[k]].tobytes().decode() for k in range(o[i], o[i + 1])] for i in range(b.n)]
        assert found == [["ab", "c"], [], [], ["日", "x"], []]
    b = next(tk.blocks(pa.array(["abcXabc", "abc"])))
    h = b.hashes(np.array([0, 4, 7, 0]), np.array([3, 7, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_quality_measures_against_brute_force(spark, docs):
    def brute(t):
        t = t or ""
        w = SPACED.findall(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    want = sorted(((d, *brute(t), brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0]) for d, t, *_ in corpus()), key=repr)
    got = quality.verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got) == want


def test_quality_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, bad if i % 10 else good, "en", "bad", 0) for i in range(200)] + [(1000 + i, good if i % 10 else bad, "en", f"h{i % 3}", 0) for i in range(200)] + [(5000, good, "en", None, 0)]
    kept = {r["doc_id"] for r in quality.verdicts(frame(spark, rows)).collect() if r["kept"]}
    assert kept == {1000 + i for i in range(200) if i % 10} | {5000}
    filtered = quality.filter_documents(frame(spark, rows))
    assert filtered.columns == [c.split()[0] for c in DOC_SCHEMA.split(", ")] and {r["doc_id"] for r in filtered.collect()} == kept
    a, b = quality.moments(400.0, 200.0, 2.0, 80000.0, 162.0)
    assert 0 < a < 1.5 and a == pytest.approx(b)


BENCH = [(1, "The word1 of word2 word3 of the word4 word5 word6 word7 word8"), (2, "one"), (3, None), (4, ""), (None, "two words"), (5, "The word1 of word2 word3 of the word4 word5 word6 word7 word8"), (6, "small WORDS")]


def contaminated_corpus():
    rows = corpus(3)
    passage = BENCH[0][1].replace(" ", ", ")
    return rows + [(9001, "before it " + passage + " after", "en", "s", 0), (9002, passage + passage[:40] + passage, "en", "s", 0), (9003, " ".join(BENCH[0][1].split()[:9]), "en", "s", 0)]


@pytest.mark.parametrize("block_words", [1_000_000, 1])
def test_decontamination_against_brute_force(spark, block_words):
    windows: dict[tuple, set] = {}
    for item, text in BENCH:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    want = []
    for d, text, *_ in contaminated_corpus():
        w, hit, items = ALNUM.findall((text or "").translate(ASCII_LOWER)), set(), set()
        for key, who in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    items |= who
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = frame(spark, contaminated_corpus(), True).repartition(2)
    got = decontaminate.report(docs, bench, block_words)
    assert rows_of(got.select(*got.columns[:6])) == sorted(want, key=repr)
    runs = {r["doc_id"]: [tuple(map(int, x.split(":"))) for x in r["hit_spans"].split(",") if x] for r in got.filter("doc_id >= 9000").collect()}
    assert runs[9001] == [(2, 14)] and runs[9003] == [] and all(sum(b - a for a, b in x) == n for d, _, n, *_ in want for x in [runs.get(d)] if x is not None)
    places = {r["doc_id"]: (r["longest_match"], r["match_word"], r["match_item"], r["match_item_word"]) for r in got.collect()}
    assert places[9001] == (12, 2, "1", 0) and places[9003] == (9, 0, "1", 0) and places[0] == (0, None, None, None)
    clean = decontaminate.filter_documents(docs, bench, block_words)
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == sorted(d or -1 for d, *_, c in want if not c)


def test_longest_match_walks_beyond_the_sorted_depth():
    w = [f"q{i}" for i in range(40)]
    bench = decontaminate.Benchmark(["a"], decontaminate.item_words(pa.array([" ".join(w)])))
    texts = pa.array([" ".join(["z", *w[5:35], "z"]), " ".join(w[:3]), "nothing here", " ".join(w)])
    assert [x[2] for x in decontaminate.search_texts(texts, bench)] == [(30, 1, "a", 5), (3, 0, "a", 0), decontaminate.NO_MATCH, (40, 0, "a", 0)]


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_against_brute_force(seed):
    """Items that share passages and repeat themselves, in few words, so that ties are many."""
    r = random.Random(seed)
    prose = lambda n: [r.choice("abcd") for _ in range(n)]
    items = [prose(r.randint(1, 30)) for _ in range(6)]
    items[3] = items[0] + items[1]
    texts = [prose(r.randint(0, 60)) + r.choice(items) + prose(3) for _ in range(20)]
    bench = decontaminate.Benchmark([str(i) for i in range(6)], decontaminate.item_words(pa.array([" ".join(x) for x in items])))

    def brute(w):
        found = []
        for p in range(len(w)):
            for i, item in enumerate(items):
                for q in range(len(item)):
                    n = 0
                    while p + n < len(w) and q + n < len(item) and w[p + n] == item[q + n]:
                        n += 1
                    if n > 1 or (n and len(item) == 1):
                        found.append((-n, p, i, q))
        return (-min(found)[0], min(found)[1], str(min(found)[2]), min(found)[3]) if found else decontaminate.NO_MATCH

    assert [x[2] for x in decontaminate.search_texts(pa.array([" ".join(w) for w in texts]), bench)] == [brute(w) for w in texts]


def brute_components(rows, k):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return [(d, len(s), root(d) if d is not None else None, root(d) == d if d is not None else True) for d, s in sets]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, docs, k):
    assert rows_of(neardup.report(docs, k, 80)) == sorted(brute_components(corpus(), k), key=repr)


def test_near_duplicates_with_long_posting_lists(spark):
    """Many near copies of one text: hot lists, star pairs and the comparison across components."""
    r = random.Random(5)
    base = [f"t{r.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(100), r.choice([1, 2, 3, 4, 5])):
            w[at] = f"m{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    run = neardup.NearDuplicates(frame(spark, rows), 4, 80, hot=4)
    got = {(x["doc_id"], x["component_id"]) for x in run.run().collect()}
    assert got == {(d, c) for d, _, c, _ in brute_components(rows, 4)}


def test_near_duplicates_send_the_driver_packed_counts_only(spark, monkeypatch):
    """However many cells of the sketch are hot, the driver gets a row for each chunk of them and not one for each cell."""
    assert [neardup.sketch_bits(n) for n in (0, 250_000, 3_000_000, 10**9)] == [22, 22, 25, 26]
    monkeypatch.setattr(neardup, "SKETCH_BITS", neardup.CHUNK_BITS + 2)
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("cells sent to the driver one by one"))
    sent, cast = [], type(spark.sparkContext).broadcast

    def seen(self, value):
        sent.append(value)
        return cast(self, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", seen)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(family(random.Random(4), 60, 400, [1, 3, 6]))]
    found = neardup.NearDuplicates(frame(spark, rows), 4, 80, hot=1).run()
    assert {(x["doc_id"], x["component_id"]) for x in found.collect()} == {(d, c) for d, _, c, _ in brute_components(rows, 4)}
    bits, chunks = sent[0]
    assert len(chunks) == 1 << bits - neardup.CHUNK_BITS and sum(len(c) for _, c in chunks) < 1 << bits


def family(r: random.Random, size: int, n: int, edits, vocabulary: int = 10**6) -> list[str]:
    """Copies of one text of `size` words, each with some words changed."""
    base, out = [f"t{r.randrange(10**6)}" for _ in range(size)], []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(size), r.choice(edits)):
            w[at] = f"m{r.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_collect_the_drivers_garbage_between_steps(spark, docs):
    """Spark keeps the state and files of a shuffle until then, and the heap grows with what is not in use."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName())]
    before = sum(b.getCollectionCount() for b in beans)
    neardup.NearDuplicates(docs, 4, 80).run()
    assert sum(b.getCollectionCount() for b in beans) >= before + 5


def test_near_duplicates_of_more_than_a_thousand_classes_in_a_list(spark):
    """Copies near and below the threshold, with changes in common and without, cut short and lengthened; a passage in
    texts that differ otherwise; a variant of the text with copies of its own; an id with several texts."""
    r = random.Random(8)
    texts = family(r, 60, 1100, [1, 2, 3, 4, 5], 40)
    texts += [" ".join(t.split()[: r.randint(48, 60)]) for t in r.sample(texts, 60)] + [t + " and more of it" for t in r.sample(texts, 20)]
    variant = texts[0].split()[:36] + [f"v{i}" for i in range(24)]
    texts += [" ".join(f"u{r.randrange(10**6)}" if r.random() < 0.03 else w for w in variant) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'own{i}x{j}' for j in range(r.choice([4, 6, 9])))}" for i in range(120)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    want = brute_components(rows, 4)
    assert len({c for *_, c, _ in want}) > 50
    assert rows_of(neardup.report(frame(spark, rows).repartition(4), 4, 80)) == sorted(want, key=repr)
    again = [(i % 900, t, *_) for i, t, *_ in rows]
    comps = {d: c for d, _, c, _ in brute_components(again, 4)}
    assert {(x["doc_id"], x["component_id"]) for x in neardup.report(frame(spark, again), 4, 80).collect()} == set(comps.items())


def test_near_duplicate_work_grows_with_the_group(spark, monkeypatch):
    """Rows of the tables between the steps, on one group of near copies and one twice as large."""
    made: list[int] = []
    put = neardup.Scratch.put

    def counted(self, df, *a):
        out = put(self, df, *a)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup.Scratch, "put", counted)
    sums = []
    for n in (400, 800):
        made.clear()
        rows = [(i, t, "en", "s", 0) for i, t in enumerate(family(random.Random(3), 100, n, [1, 2, 4, 6, 8]))]
        neardup.NearDuplicates(frame(spark, rows), 4, 80).run()
        sums.append(sum(made))
    assert sums[1] < 2.6 * sums[0]


def test_signatures_of_links_at_the_threshold_agree():
    """Of pairs at exactly 0.8, none agrees on fewer coordinates than a link must."""
    r = np.random.default_rng(6)
    least = 64
    for n in (9, 45, 180, 450):  # of n shingles in all, 0.8 are shared
        shared, alone = round(0.8 * n), n - round(0.8 * n)
        sets, at = [], [0]
        for _ in range(1000):
            both = r.integers(0, 1 << 63, shared, np.uint64) * np.uint64(2)
            more = r.integers(0, 1 << 63, alone, np.uint64) * np.uint64(2)
            for part in (np.concatenate((both, more[: alone // 2])), np.concatenate((both, more[alone // 2 :]))):
                sets.append(part)
                at.append(at[-1] + len(part))
        sig = neardup.signatures(np.concatenate(sets), np.array(at))
        least = min(least, int((sig[0::2] == sig[1::2]).sum(1).min()))
    assert least >= neardup.match_threshold(80)


def test_near_duplicate_filter_keeps_one_of_each(spark, docs):
    want = Counter(d for d, _, _, kept in set(brute_components(corpus(), 5)) if kept and d is not None)
    got = Counter(r["doc_id"] for r in neardup.filter_documents(docs).collect() if r["doc_id"] is not None)
    assert got == want
    assert neardup.match_threshold(80) == 32


def test_near_dedup_stage_of_the_pipeline_collects_no_cells(spark, docs, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("cells sent to the driver one by one"))
    want = Counter(d for d, _, _, kept in set(brute_components(corpus(), 5)) if kept and d is not None)
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect() if r["doc_id"] is not None) == want


def brute_lines(rows):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(ASCII_LOWER)
    holders: dict[str, set] = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and d is not None:
                holders.setdefault(key(x), set()).add(d)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or hot.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_line_dedup_against_brute_force(spark, docs):
    want = sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute_lines(corpus())), key=repr)
    assert rows_of(linestore.report(docs)) == want
    filtered = {(r["doc_id"], r["text"], r["n_chars"]) for r in linestore.filter_lines(docs).collect() if r["doc_id"] is not None and r["text"] is not None}
    assert filtered == {(d, t, len(t)) for (d, _, _, t), row in zip(brute_lines(corpus()), corpus(), strict=True) if d is not None and row[1] is not None}


def test_line_store_levels(spark):
    from graphloom.llm.scratch import Scratch

    store = linestore.LineStore(Scratch(spark, "t"), fanout=2)
    for k in range(4):
        store.add(spark.createDataFrame([(100 - k, h, h) for h in range(k, k + 5)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in store.levels] == [0, 0, 1] and store.compactions == 3
    got = {r["h1"]: (r["n_docs"], r["keeper"]) for r in store.stats().collect()}
    assert got == {h: (sum(k <= h < k + 5 for k in range(4)), 100 - max(0, h - 4)) for h in range(8)}


def test_packing_groups_slots_and_balance(spark, docs):
    got = packing.pack(docs, 4).collect()
    assert len(got) == len(corpus())
    sizes = Counter()
    shards: dict[tuple, set] = {}
    slots: dict[int, list] = {}
    text = {}
    for d, t, *_ in corpus():
        text.setdefault(d, t)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shards.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        if r["doc_id"] is not None:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert all(len(x) == 1 for x in shards.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for _, t, *_ in corpus():
        groups[t or ""] += len((t or "").encode()) + 1
    # The largest group is more than an equal share: it has a shard to itself, and the rest is near equal.
    first, *rest = sorted(sizes.values(), reverse=True)
    assert first == max(groups.values()) and len(sizes) == 4 and max(rest) - min(rest) <= 2 + max(rest) // 200


def test_packing_against_brute_force(spark):
    """The whole query on random groups: the shards that best fit in decreasing order makes of the group sizes."""
    r = random.Random(11)
    texts = [f"{i}:" + "x" * r.choice([3, 17, 17, 40, 90, 300]) for i in range(60)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(t for t in texts for _ in range(r.choice([1, 1, 2, 5])))]
    groups = Counter(t for _, t, *_ in rows)
    sizes = {t: n * (len(t) + 1) for t, n in groups.items()}
    capacity = packing.smallest_capacity(list(Counter(sizes.values()).items()), 5)
    bins: list[int] = []
    for s in sorted(sizes.values(), reverse=True):
        fit = [(left, b) for b, left in enumerate(bins) if left >= s]
        if not fit:
            bins.append(capacity)
        _, b = min(fit) if fit else (0, len(bins) - 1)
        bins[b] -= s
    got = packing.pack(frame(spark, rows), 5).collect()
    made = Counter()
    for x in got:
        made[x["shard"]] += x["size"]
    assert sorted(made.values()) == sorted(capacity - left for left in bins) and len(bins) == 5
    assert capacity <= -(-sum(sizes.values()) // 5) * 1.02


def test_packing_rounds_large_sizes_alike(spark):
    row = spark.createDataFrame([(1,), (65_535,), (65_536,), (65_537,), (1_000_003,), (1 << 40,)], "n long").select(packing._class_size(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in row] == [1, 65_535, 65_536, 65_538, 1_000_016, 1 << 40]


def test_best_fit_decreasing_is_the_textbook_rule():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 60))]
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= s]
            if fit:
                b = min(fit, key=lambda b: (bins[b], b))
            else:
                bins.append(100)
                b = len(bins) - 1
            bins[b] -= s
        places = packing.best_fit_decreasing(list(Counter(sizes).items()), 100)
        left = Counter()
        for size, _, n, b in places:
            left[b] += size * n
        assert sorted(100 - x for x in left.values()) == sorted(bins)
        c = packing.smallest_capacity(list(Counter(sizes).items()), 5)
        assert packing.best_fit_decreasing(list(Counter(sizes).items()), c, 5) is not None
    assert packing.best_fit_decreasing([(5, 2)], 4, 3) is None


def test_license_base_and_labels(spark):
    texts = [
        "Mit license and MIT-License, apache\nlicense general public  license", None, "", "mit licenses", "noise " * 40 + "Licensed under the Apache License, Version 2.0. " + "noise " * 40,
        "Licensed under CC BY-NC 4.0.", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining ONE copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ]
    got = {r["doc_id"]: r.asDict() for r in licenses.scan(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], True)).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(ASCII_LOWER))
        places = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    assert got[4]["labels"] == "apache" and got[4]["score"] == 1 and got[5]["labels"] == "cc-by-nc" and got[6]["labels"] == "" and got[7]["labels"] == "mit" and got[7]["base_labels"] == ""
    span = licenses.spans(frame(spark, [(1, texts[4], "en", "s", 0)])).filter("verified").collect()
    assert [(r["first_word"], r["last_word"]) for r in span] == [(40, 47)]


def brute_labels(text: str | None, k: int = licenses.K) -> set[str]:
    """Diagonal voting in plain Python: grams as tuples of words, one template after another."""
    w, found = ALNUM.findall((text or "").translate(ASCII_LOWER)), set()
    for label, template in licenses.TEMPLATES:
        t = ALNUM.findall(template.translate(ASCII_LOWER))
        hits: dict[int, list] = {}
        for p in range(len(w) - k + 1):
            for q in range(len(t) - k + 1):
                if w[p : p + k] == t[q : q + k]:
                    hits.setdefault(p - q, []).append((p, q))
        gap, groups = min(licenses.GAP, len(t) // licenses.WORDS_PER_GAP), []
        for d in sorted(hits):
            if groups and d - groups[-1][0] <= gap:
                groups[-1] = (d, groups[-1][1] + hits[d])
            else:
                groups.append((d, hits[d]))
        for _, places in groups:
            covered = {q + j for _, q in places for j in range(k)}
            width = max(p for p, _ in places) + k - min(p for p, _ in places)
            if len(covered) >= (licenses.MIN_COVER if len(t) >= licenses.WORDS_PER_GAP else 1) * len(t) and width <= max(licenses.MAX_STRETCH * len(t), len(t) + 2 * licenses.GAP):
                found.add(label)
    return found


def test_license_labels_against_brute_force(spark):
    """Templates whole, with words changed, left out and put in, between other words; rows that repeat, share a doc_id or
    have none; a very long text; near misses: another Creative Commons license, a third of a notice."""
    r = random.Random(4)
    noise = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    texts = [t for _, t in licenses.TEMPLATES]
    for _, t in licenses.TEMPLATES:
        for _ in range(3):
            w = t.split()
            for _ in range(r.randint(0, 1 + len(w) // 12)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [r.choice(VOCAB)], [w[at], r.choice(VOCAB)]])
            texts.append(noise(r.randint(0, 40)) + " " + " ".join(w) + "\n" + noise(r.randint(0, 40)))
        texts.append(" ".join(t.split()[: len(t.split()) // 3]))
    texts += [noise(30_000) + " " + licenses.TEMPLATES[2][1] + noise(50), None, "", licenses.TEMPLATES[0][1] * 3]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(1, "Licensed under CC BY-NC 4.0.", "en", "s", 0), (1, "nothing here at all", "en", "s", 0), (None, "Licensed under CC BY 4.0.", "en", "s", 0), (None, "nothing here", "en", "s", 0), rows[0], rows[0]]
    got = licenses.scan(frame(spark, rows, True).repartition(3)).select("doc_id", "n_words", "base_labels", "labels", "score").collect()
    want = []
    for d, t, *_ in rows:
        w, low = ALNUM.findall((t or "").translate(ASCII_LOWER)), " " + " ".join(ALNUM.findall((t or "").translate(ASCII_LOWER))) + " "
        base = {x for p, x in licenses.PHRASES if f" {p} " in low}
        own = brute_labels(t)
        want.append((d, len(w), ",".join(sorted(base)), ",".join(sorted(base | own)), bool(own)))
    assert sorted(((*x[:4], x["score"] > 0) for x in got), key=repr) == sorted(want, key=repr)
    by = {t: brute_labels(t) for _, t in licenses.TEMPLATES}
    assert all(label in by[t] for label, t in licenses.TEMPLATES) and by["Licensed under CC BY-NC 4.0."] == {"cc-by-nc"}
    assert all(len(x) == 1 for t, x in by.items() if "Creative Commons" in t)


def test_random_strings_are_found_and_identifiers_left_alone():
    """Recall on random strings, and false alarms on identifiers, digests and plain words."""
    import base64
    import string

    r = random.Random(12)
    enc = secrets.encoding(RANKS, public_tokenizers.PATTERN)
    flagged = lambda s: any(k == 3 for *_, k in secrets.scan_block(next(tk.blocks(pa.array([f"x {s} y"]))), enc)[0])
    alnum = string.ascii_letters + string.digits
    kinds = {
        "base62": lambda: "".join(r.choice(alnum) for _ in range(r.randint(24, 48))), "base64": lambda: base64.b64encode(r.randbytes(r.randint(18, 40))).decode(), "urlsafe": lambda: base64.urlsafe_b64encode(r.randbytes(30)).decode(),
        "base32": lambda: base64.b32encode(r.randbytes(20)).decode(),
    }
    for kind, make in kinds.items():
        found = sum(flagged(make()) for _ in range(300)) / 300
        assert found >= 0.97, (kind, found)
    words = "this is a very long url slug for page the user profile image upload handler config value test data model train index search query result total count first last name email address street city".split()
    some = lambda n: [r.choice(words) for _ in range(n)]
    plain = {
        "slug": lambda: "-".join(some(8)), "snake": lambda: "_".join(some(5)), "path": lambda: "/usr/local/lib/python3/" + "/".join(some(4)), "date": lambda: "/".join(f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}" for _ in range(3)),
        "constant": lambda: "_".join(some(5)).upper(), "camel": lambda: "".join(w.title() for w in some(6)), "md5": lambda: hashlib.md5(r.randbytes(9)).hexdigest().upper(), "sri": lambda: "sha512-" + base64.b64encode(r.randbytes(64)).decode(),
        "stamp": lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z", "uuid": lambda: "id-" + "-".join(r.randbytes(n).hex().upper() for n in (4, 2, 2, 2, 6)), "rule": lambda: "=" * 40, "digits": lambda: "".join(r.choice("0123456789") for _ in range(30)),
    }
    for kind, make in plain.items():
        false = sum(flagged(make()) for _ in range(200)) / 200
        assert false <= 0.01, (kind, false)
    assert not flagged("this-is-a-very-long-url-slug-for-a-page") and not flagged("2024-01-01/2024-02-02/2024-03")


def test_secret_scan_of_repeated_rows_null_ids_and_a_long_text(spark):
    secret = "q7Xz9LmP2vRt8KwY4nBc6JdF1hGs"
    rows = [(1, secret, "en", "s", 0), (1, secret, "en", "s", 0), (None, secret, "en", "s", 0), (1, "nothing", "en", "s", 0), (2, "é word " * 300_000 + secret, "en", "s", 0), (3, "a" * 3_000_000, "en", "s", 0)]
    got = [(r["doc_id"], r["spans"]) for r in secrets.scan(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()]
    whole = f"random:0:{len(secret)}"
    assert sorted((x for x in got if x[0] != 3), key=repr) == sorted([(1, whole), (1, whole), (None, whole), (1, ""), (2, f"random:2100000:{2100000 + len(secret)}")], key=repr)


def test_secret_scan_against_brute_force(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [
        "päss password=hunter2 API-key: zzz apikey : 'abc/def=' x", "token: token: abcdef", None, "", "AKIA" + "Z9" * 10 + " AKIASHORT", hexes + " é " + hexes[:23] + " " + hexes[:24],
        "SECRET=short tokEN =  \"longer_value\"", "key q7Xz9LmP2vRt8KwY4nBc6JdF1hGs end", "snake_case_identifier_name_here 123e4567-e89b-12d3-a456-426614174000 " + hashlib.md5(b"q").hexdigest(), "passwordpassword=abcdefgh",
    ]
    assign = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    got = {r["doc_id"]: r for r in secrets.scan(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], True), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and ",".join(x for x in r["spans"].split(",") if x[:6] != "random") == base
    assert got[7]["spans"] == "random:4:32" and "random" not in got[8]["spans"]


def test_language_mixture(spark):
    r = random.Random(9)
    words = {"en": ["the", "and", "with", "house", "ing", "tion"], "de": ["der", "und", "mit", "haus", "ung", "keit"], "fr": ["le", "et", "avec", "maison", "ement", "eau"]}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang := ["en", "de", "fr"][i % 3], 30), lang, "s", 0) for i in range(240)] + [(900, None, "en", "s", 0), (901, "123 !?", "de", "s", 0), (902, "", None, "s", 0), (903, "Я", "fr", "s", 0), (None, "the and with the house", None, None, None)]
    got = langmix.report(frame(spark, rows, True)).collect()
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == rows[i][2] for i in range(240)) and all(0 <= x["score"] <= 1 for x in got)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == by[902]["lang_pred"] == "und" and by[903]["lang_pred"] != "und" and by[None]["lang_pred"] == "en"
    # A document of two thirds German and one third French is found out as that mixture.
    mixed = prose("de", 400) + " " + prose("fr", 200)
    model = langmix.train(frame(spark, rows))
    block = next(tk.blocks(pa.array([mixed])))
    lang, score, mixture = langmix.predict_block(block, model)
    shares = dict(x.split(":") for x in mixture[0].split(","))
    assert lang == ["de"] and set(shares) == {"de", "fr"} and float(shares["fr"]) == pytest.approx(1 / 3, abs=0.08)
    assert langmix.predict(frame(spark, rows[:2]), langmix.train(frame(spark, rows).filter("false"))).first()["lang_pred"] == "und"


def test_mixture_against_plain_em():
    """Shares, sets of languages and posteriors against expectation-maximisation in plain Python."""
    r = np.random.default_rng(3)
    at, rows = [0], []
    p = r.dirichlet(np.full(40, 0.3), 3).T + 1e-4
    for share in ([1, 0, 0], [0.5, 0.5, 0], [0.3, 0.3, 0.4], [0, 0.05, 0.95], [0, 0, 1]):
        n = r.multinomial(300, (p @ np.array(share)) / (p @ np.array(share)).sum())
        rows.append([(g, c) for g, c in enumerate(n.tolist()) if c])
        at.append(at[-1] + len(rows[-1]))

    def em(doc, allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(langmix.ROUNDS):
            total = dict.fromkeys(allowed, 0.0)
            for g, c in doc:
                whole = sum(p[g, k] * share[k] for k in allowed)
                for k in allowed:
                    total[k] += c * p[g, k] * share[k] / whole
            share = {k: v / sum(c for _, c in doc) for k, v in total.items()}
        return share, sum(c * math.log(sum(p[g, k] * share[k] for k in allowed)) for g, c in doc)

    def brute(doc):
        unit = langmix.PENALTY * 0.5 * math.log(sum(c for _, c in doc))
        single = [sum(c * math.log(p[g, k]) for g, c in doc) for k in range(3)]
        share, like = em(doc, [0, 1, 2])
        if like - max(single) <= unit:
            return {int(np.argmax(single)): 1.0}
        value = like - 2 * unit
        while len(share) > 1:
            fewer = [k for k in share if k != min(share, key=lambda k: (share[k], k))]
            s, like = em(doc, fewer)
            if like - unit * (len(fewer) - 1) < value:
                break
            share, value = s, like - unit * (len(fewer) - 1)
        return share

    flat = [x for doc in rows for x in doc]
    chosen, posterior = langmix.infer(p[[g for g, _ in flat]], np.array([c for _, c in flat], np.float64), np.array(at))
    for doc, got, sure in zip(rows, chosen, posterior, strict=True):
        want = brute(doc)
        assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == {k: v for k, v in enumerate(got) if v > 0}
        like = [sum(c * math.log(p[g, k]) for g, c in doc) for k in range(3)]
        assert sure == pytest.approx(1 / sum(math.exp(x - max(like)) for x in like), rel=1e-6)
    assert [(x > 0).sum() for x in chosen][:3] == [1, 2, 3]


def test_language_of_repeated_rows_and_a_very_long_text(spark):
    words = {"en": "the and with house", "de": "der und mit haus"}
    rows = [(i, words["en" if i % 2 else "de"] * 20, "en" if i % 2 else "de", "s", 0) for i in range(40)]
    model = langmix.train(frame(spark, rows))
    asked = [(1, words["de"] * 100_000, None, "s", 0), (2, words["en"], None, "s", 0), (2, words["en"], None, "s", 0)]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langmix.predict(frame(spark, asked), model).collect()) == [(1, "de"), (2, "en"), (2, "en")]


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rows = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenbin.report(docs, BPE).collect()), key=repr) == sorted(want, key=repr)


def test_encoder_pieces_and_full_store(monkeypatch):
    texts = pa.array(["a  b\n\n c  d 　x I'm 123abc été́ 日本", "", " ", "x \x85 y\x1c z", "<|endoftext|> it's  \n", "tab\tand em space   nbsp", "\n lead", "déjà vu naïve Übung ñandú"])
    enc = tokenbin.Encoder(BPE)
    want = [x.ids for x in enc.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    for kept in (tokenbin.MAX_KEPT, 3):
        monkeypatch.setattr(tokenbin, "MAX_KEPT", kept)
        for limit in (1, 1000):
            got = []
            for b in tk.blocks(texts, limit):
                ids, at = enc.encode(b)
                got += [ids[at[i] : at[i + 1]].tolist() for i in range(b.n)]
            assert got == want


def test_encoder_cuts_words_from_punctuation():
    """Words are kept without the signs behind them and the newline before them, and all ids stay the tokenizer's."""
    enc = tokenbin.Encoder(BPE)
    texts = pa.array(["peña peña, peña. peña!!\npeña;\npeña"])
    ids, at = enc.encode(next(tk.blocks(texts)))
    assert ids.tolist() == enc.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids and len(enc.hashes) == 7  # two words, newline, four signs
    r = random.Random(5)
    parts = [*"abZz09'.,!?-_\n\n\n  \t\r\x1c\x85\u2003—¿×÷éßŉĀƀʰ\u0301中ªµ²\x00\x7f~{Ω", "😀", "'s", "'ll", "word", "The", "<|endoftext|>"]
    texts = pa.array(["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(5000)])
    ids, at = enc.encode(next(tk.blocks(texts)))
    want = [x.ids for x in enc.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_repair_is_lossless_with_random_access():
    r = np.random.default_rng(4)
    for n in (1, 2, 50, 5000):
        ids = r.choice([5, 6, 7, 5, 5, 9, 50256], n).astype(np.uint16)
        at = np.unique(np.concatenate(([0, n], r.integers(0, n, 5))))
        sides, lengths, symbols, first = tokenbin.repair(ids, at, 50257)
        block = tokenbin.TokenBlock(tokenbin.pack_block(list(range(len(at) - 1)), np.diff(at), sides, lengths, symbols, first, 50257))
        assert np.array_equal(block.all_ids(), ids)
        for i in range(len(at) - 1):
            own = ids[at[i] : at[i + 1]]
            assert np.array_equal(block.ids(i), own)
            lo = len(own) // 3
            assert np.array_equal(block.span(i, lo, len(own)), own[lo:])
    assert len(symbols) < 5000 / 2 and len(sides) and lengths.max() > 2


def test_repair_of_a_large_vocabulary_and_until_nothing_is_frequent():
    r = np.random.default_rng(9)
    ids = np.tile(r.integers(0, 200_000, 40).astype(np.uint32), 50)
    sides, lengths, symbols, first = tokenbin.repair(ids, np.array([0, len(ids)]), 200_000, 0)
    block = tokenbin.TokenBlock(tokenbin.pack_block([7], np.array([len(ids)]), sides, lengths, symbols, first, 200_000))
    assert np.array_equal(block.ids(0), ids) and symbols.dtype == np.uint32 and len(symbols) < 14 and lengths.max() >= 160
    # Whole texts repeated: rounds go on while one still shortens the block.
    small = np.tile(np.arange(64, dtype=np.uint16), 1000)
    assert len(tokenbin.repair(small, np.array([0, len(small)]), 50_257)[2]) < 40


def lattices(text: str, p: segment.Pieces) -> list[tuple]:
    """Length, edges by end and forward sums of each unit of a text, in plain Python."""
    piece = {p.bytes[i]: (i, w) for i, w in zip(p.ids.tolist(), p.weight.tolist(), strict=True)}
    out = []
    for unit in re.findall(rb" *[^ ]+| +$", (" " + text).encode()):
        edges: dict[int, list] = {}
        for s in range(len(unit)):
            for stop in range(s + 1, min(len(unit), s + 48) + 1):
                if unit[s:stop] in piece:
                    i, w = piece[unit[s:stop]]
                    edges.setdefault(stop, []).append((s, w, [i]))
        alpha = {0: 0.0}
        for e in sorted(edges):
            v = [alpha[s] + w for s, w, _ in edges[e]]
            alpha[e] = max(v) + math.log(sum(math.exp(x - max(v)) for x in v))
        out.append((len(unit), edges, alpha))
    return out


def test_sampled_pieces_have_the_lattice_distribution():
    p = segment.pieces(PIECES)
    text = "hello there"
    n = 4000
    b = next(tk.blocks(pa.array([text] * n)))
    ids, at, _ = segment.sample_block(b, np.arange(n, dtype=np.uint64), p)
    seen = Counter(tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n))

    def ways(size, edges, alpha):
        def back(e):
            if e == 0:
                yield [], 0.0
            for s, w, i in edges.get(e, []):
                for head, v in back(s):
                    yield head + i, v + w

        return {tuple(i): math.exp(v - alpha[size]) for i, v in back(size)}

    first, second = (ways(*x) for x in lattices(text, p))
    assert sum(first.values()) == pytest.approx(1) and sum(second.values()) == pytest.approx(1)
    chance = {a + b: x * y for a, x in first.items() for b, y in second.items()}
    assert set(seen) <= set(chance)
    for way, c in chance.items():
        assert abs(seen[way] / n - c) < 5 * math.sqrt(c * (1 - c) / n) + 2e-3


def test_sampled_pieces_do_not_depend_on_the_block():
    p = segment.pieces(PIECES)
    texts = pa.array([t for _, t, *_ in corpus()])
    keys = np.arange(len(texts), dtype=np.uint64)
    found = []
    for limit in (1, 300, 20_000, 1 << 22):
        rows = []
        for b in tk.blocks(texts, limit):
            ids, at, _ = segment.sample_block(b, keys[b.first : b.first + b.n], p)
            rows += [ids[at[i] : at[i + 1]].tolist() for i in range(b.n)]
        found.append(rows)
    assert found[0] == found[1] == found[2] == found[3]


def test_sampled_pieces_are_lossless_and_depend_on_the_key_alone(spark, docs):
    p = segment.pieces(PIECES)
    one = {(r["doc_id"], tuple(r["ids"])) for r in segment.sample(docs, PIECES).collect() if r["doc_id"] is not None}
    two = {(r["doc_id"], tuple(r["ids"])) for r in segment.sample(docs.repartition(7), PIECES).collect() if r["doc_id"] is not None}
    assert one == two
    texts = {d: t for d, t, *_ in corpus() if d is not None}
    assert all(segment.decode_text(ids, p) == (texts[d] or "") for d, ids in one)
    digest = {r["doc_id"]: (r["n_pieces"], r["lossless"], r["ids_crc32"]) for r in segment.report(docs, PIECES).collect()}
    assert all(digest[d] == (len(ids), True, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in one)
    assert {(r["doc_id"], tuple(r["ids"])) for r in segment.sample(docs, PIECES, seed=1).collect()} != one


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality.verdicts(none), quality.filter_documents(none), decontaminate.report(none, bench), decontaminate.filter_documents(none, bench), neardup.report(none), neardup.filter_documents(none),
        linestore.report(none), linestore.filter_lines(none), packing.pack(none), licenses.scan(none), secrets.scan(none, RANKS, public_tokenizers.PATTERN), langmix.report(none), tokenbin.report(none, BPE), segment.report(none, PIECES), segment.sample(none, PIECES),
    ):
        assert df.count() == 0
    some = frame(spark, [(1, "a b", "en", "s", 3)])
    assert decontaminate.report(some, bench).first()["contaminated"] is False


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = contaminated_corpus() + [(20000 + i, " ".join(f"v{random.Random(i).randrange(10**6)}x{j}" for j in range(70)), "en", "s", 0) for i in range(5)]
    rows = [r for r in rows if r[0] is not None]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH[:1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in quality.verdicts(docs).collect() if r["kept"]}
    left = [(d, t, *r[2:]) for r in rows if r[0] in kept for d, _, _, t in brute_lines([x for x in rows if x[0] in kept]) if d == r[0]]
    comps = {d for d, _, _, k in brute_components(left, 5) if k}
    left = [r for r in left if r[0] in comps]
    w10 = {tuple(w[i : i + 10]) for w in [ALNUM.findall(BENCH[0][1].translate(ASCII_LOWER))] for i in range(len(w) - 9)}

    def clean(t):
        w = ALNUM.findall(t.translate(ASCII_LOWER))
        return not any(tuple(w[i : i + 10]) in w10 for i in range(len(w)))

    want = {r[0]: r[1] for r in left if clean(r[1])}
    p = segment.pieces(PIECES)
    got = {r["doc_id"]: segment.decode_text(r["ids"], p) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sampled_pieces"]


def thue_morse(n: int) -> tuple[str, str]:
    """The Thue-Morse string of n letters and its complement: equal under polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_strings_that_polynomial_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    block = next(tk.blocks(pa.array([a + b])))
    h = block.hashes(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    words = [f"w{i}" for i in range(60)]
    texts = [a, b, *(f"{a}\nrow {i}" for i in range(5)), *(f"{b}\nrow {i}" for i in range(5)), f"{a} x {a} x {b} x {b}", f"{a}\n{b}\n{a}", " ".join([*words, a]), " ".join([*words, b])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in tokenbin.report(docs, BPE).collect()} == want
    assert all(r["lossless"] for r in segment.report(docs, PIECES).collect())
    lines = {(d, k, g, hashlib.sha256(x.encode()).hexdigest()) for d, k, g, x in brute_lines(rows)}
    assert {tuple(r) for r in linestore.report(docs).collect()} == lines
    assert rows_of(neardup.report(docs, 4, 80)) == sorted(brute_components(rows, 4), key=repr)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench).collect()}
    assert hit == {i: ALNUM.findall(x).count(a) for i, x in enumerate(texts)}
    measures = quality.measure_batch(pa.array(texts))
    assert measures[12, 4] == 0 and measures[13, 3] == 1


def test_equal_hashes_do_not_decide(monkeypatch):
    """With all hashes cut to three bits, bytes still tell pieces and units apart."""
    whole = tk.Block.hashes
    monkeypatch.setattr(tk.Block, "hashes", lambda self, *a: whole(self, *a) & np.uint64(7))
    texts = pa.array([t or "" for _, t, *_ in corpus()][:30])
    enc, p = tokenbin.Encoder(BPE), segment.pieces(PIECES)
    want = [x.ids for x in enc.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    for b in tk.blocks(texts):
        ids, at = enc.encode(b)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(b.n)] == want
        ids, bounds, block = segment.sample_block(b, np.arange(b.n, dtype=np.uint64), p)
        assert segment._lossless(ids, bounds, block, p).all()
