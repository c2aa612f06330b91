"""Operators in which rows meet."""
import hashlib
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise import lineage
from turnwise.llm import fingerprints, jaccard_join, mixing, packing


# fingerprints

def shingles(text, width):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else Counter([tuple(words)] if words else [])


def general_jaccard(a, b):
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both) if both else 1.0


def check_fingerprints(rows, texts):
    """texts: (doc_id, text) in the order that next means."""
    after = {d: texts[(i + 1) % len(texts)][1] for i, (d, _) in enumerate(texts)}
    own = dict(texts)
    errors = []
    for r in rows:
        text, k = own[r["doc_id"]], len(own[r["doc_id"]]) // 3
        edited = text[:len(text) - k] + after[r["doc_id"]][:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - general_jaccard(shingles(text, 5), shingles(edited, 5)), r["near_next"] - general_jaccard(shingles(text, 5), shingles(after[r["doc_id"]], 5))]
    return errors


def test_fingerprint_query(run, plain):
    errors = check_fingerprints(run("op1_fingerprints"), [(d, plain[d]["text"] or "") for d in sorted(plain, reverse=True)])
    assert np.sqrt(np.mean(np.square(errors))) < 0.08 and abs(np.mean(errors)) < 0.02


def test_fingerprints_of_weighted_terms(spark):
    """Collisions follow generalised Jaccard, weights included, where a bin has several terms."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        a = [f"t{int(rng.expovariate(1 / 300))}" for _ in range(2500)]
        b = [w if rng.random() < 0.6 else f"t{int(rng.expovariate(1 / 400))}" for w in a]
        rows.append((i, " ".join(a), " ".join(b)))
    near = fingerprints.likeness(fingerprints.samples(F.col("a"), width=1), fingerprints.samples(F.col("b"), width=1))
    got = spark.createDataFrame(rows, "id long, a string, b string").select("id", near.alias("n")).collect()
    want = {i: general_jaccard(Counter(a.split()), Counter(b.split())) for i, a, b in rows}
    errors = [r["n"] - want[r["id"]] for r in got]
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.06, (np.mean(errors), np.std(errors))


def test_fingerprint_rows(spark, docs, nothing):
    rows = fingerprints.compare_with_next(docs).collect()
    assert len(rows) == docs.count() and fingerprints.compare_with_next(nothing).count() == 0
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[5] == by[6] and by[2] == by[3] == by[7] == {""}
    one = fingerprints.compare_with_next(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    ids = [0, 1, 4095, 4096, 4097, 1 << 30, (1 << 30) + 1, 1 << 40, -5, -4097, 9_000_000_000_000_000_000]
    texts = [(i, f"text of {i} " * 30) for i in sorted(ids, reverse=True)]
    check_fingerprints(fingerprints.compare_with_next(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


# Jaccard join

def plain_join(rows, width=4, alike=85):
    """Components by comparing every pair."""
    sets = []
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= alike * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min((x for x in (d, least.get(find(i))) if x is not None), default=None)
    return {d: (len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)}


def bridge():
    """Texts 5 and 9 that only a third one, of 100 words, links; it has 0.92 of either and they have 0.85 of each other."""
    words = [f"w{i}" for i in range(100)]
    return " ".join(["a"] * 4 + words[4:]), " ".join(words), " ".join(words[:96] + ["z"] * 4)


def test_rows_without_doc_id_link_others(spark):
    """A row without doc_id is a bridge like any other, and one that is linked has its component."""
    left, middle, right = bridge()
    for rows in ([(5, left), (None, middle), (9, right)], [(5, left), (None, middle), (None, middle), (9, right), (9, right)]):
        got = jaccard_join.join_alike(spark.createDataFrame(rows, "doc_id int, text string"), 4, 90).collect()
        assert {r["component_id"] for r in got} == {5} and len(got) == len(rows)
    apart = jaccard_join.join_alike(spark.createDataFrame([(5, left), (9, right)], "doc_id int, text string"), 4, 90).collect()
    assert {r["component_id"] for r in apart} == {5, 9}


def test_seldom_dealt_again():
    """Sets of any size have about as many keys as their bands may have differences."""
    rng = np.random.default_rng(3)
    for alike in (80, 85):
        for n in (50, 150, 300, 500, 1000, 3000):
            made = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(20)]
            wanted = sum(d + 1 for _, _, d in jaccard_join._bands_of(n, alike))
            assert np.mean([len(jaccard_join.segment_keys(x, alike)) for x in made]) <= 1.1 * wanted


def test_join_finds_every_link(spark):
    """Groups of near copies around the threshold, of all sizes, against all pairs."""
    rng = random.Random(11)
    rows, doc_id = [], 0
    for size in [5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20, 25, 30, 40, 60, 90, 140, 220, 350] * 3:
        base = [f"w{rng.randint(0, 400)}" for _ in range(size + 3)]
        for _ in range(rng.randint(2, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            cut = rng.randint(0, max(0, size // 12))
            rows.append((doc_id, " ".join(words[cut:] if rng.random() < 0.5 else words)))
            doc_id += rng.randint(1, 3)
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_join(rows)


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Edits of one word each that keep 0.8 of the shingles of five words, but less than 0.85 of those of four."""
    words = [f"w{i}" for i in range(454)]
    other = [f"x{i}" if i % 45 == 20 else w for i, w in enumerate(words)]  # 10 words
    far = [f"y{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    a, b, c = (set(shingles(" ".join(x), 5)) for x in (words, other, far))
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
    assert {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in jaccard_join.one_of_each(docs, 5, 80, 100).collect()} == {1, 3}
    assert {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == {1, 3}


@pytest.mark.parametrize("size", [6, 11, 12, 40, 333, 2000])
def test_linked_sets_share_a_key_at_four_fifths(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a, rng.integers(1, 1 << 63, int(rng.integers(0, len(a) // 4 + 1)), dtype=np.uint64)]))
        if len(b) > len(a):
            assert set(jaccard_join.segment_keys(a, 80, 100).tolist()) & set(jaccard_join.segment_keys(b, 80, 100).tolist())


@pytest.mark.parametrize("size", [6, 11, 12, 40, 333, 2000])
def test_linked_sets_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
        most = 15 * len(a) // 85
        b = np.unique(np.concatenate([a, rng.integers(1, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
        drop = int(rng.integers(0, max(1, (100 * len(a) - 85 * len(b)) // 100 + 1)))
        c = np.setdiff1d(a, rng.choice(a, drop, replace=False))
        for x, y in ((a, b), (a, c), (c, b)):
            inter, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            apart = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in jaccard_join.bit_sketch(x) ^ jaccard_join.bit_sketch(y))
            assert apart <= union - inter
            if 100 * inter >= 85 * union and inter < union:
                assert set(jaccard_join.segment_keys(x).tolist()) & set(jaccard_join.segment_keys(y).tolist())


def test_blocks_join_what_leaders_do_not(spark):
    """A ring in which no set is like many others: leaders alone would leave it in parts."""
    rng = random.Random(4)
    words = [f"r{i}" for i in range(160)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = rng.randrange(len(words))
        words[at] = f"new{i}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_join(rows)


def test_join_rows(spark, docs, nothing):
    rows = jaccard_join.join_alike(docs).collect()
    assert len(rows) == docs.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[5] == found[6] == (1, 5) and found[2] == (0, 2) and found[7] == (0, 7) and found[1] == (7, 1)
    kept = jaccard_join.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7, 8, 9] and kept.columns == docs.columns
    assert jaccard_join.one_of_each(nothing).count() == 0


# mixing

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        want = {s: 2.0 * sizes[s] if s in full else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and want[s] > 2 * sizes[s]}
        if not over:
            return want
        full |= over


def check_mix(rows, sources):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[sources[r["doc_id"]]] += r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1 + 0.01 * target, (s, taken[s], target)


def test_mixing_query(run, plain):
    rows = run("op4_mixing")
    assert len(rows) == len(plain)
    check_mix(rows, {d: r["source"] for d, r in plain.items()})


def test_mixing_rows(spark, docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(nothing).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.copies(docs).columns == docs.columns and mixing.copies(nothing).count() == 0
    uneven = [(i, "w " * rng, s) for i, (rng, s) in enumerate([(5000, "a"), (3, "b"), (2, "b"), (0, "c"), (40, None), (1, None), (900, "d"), (901, "d")])]
    frame = spark.createDataFrame(uneven, "doc_id long, text string, source string")
    check_mix(mixing.mix(frame).collect(), {i: s for i, _, s in uneven})


# packing

def check_packing(pieces, ids, length=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"]:p["start"] + p["length"]], dtype="<u4").tobytes())
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))

    def joined(parts):
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        return at
    assert {d: joined(x) for d, x in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    full = [joined(x) for x in by_sequence.values()]
    assert max(full) <= length and sum(f < length for f in full) <= 1
    return by_sequence


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.tokenizer_file())
    return lambda text: made.encode(text, add_special_tokens=False).ids + [1]


def test_packing_query(run, plain, encode):
    pieces = run("op6_packing")
    check_packing(pieces, {d: encode(r["text"] or "") for d, r in plain.items()})


def test_windows_keep_shares(spark, encode):
    docs = [(i, " ".join(f"word{i}" for _ in range(40 + i % 60)), f"s{i % 7 % 3}") for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    pieces = packing.pack(frame, window=8 * 256, length=256).collect()
    ids = {i: encode(t) for i, t, _ in docs}
    check_packing(pieces, ids, 256)
    source, total = {i: s for i, _, s in docs}, Counter()
    for i, x in ids.items():
        total[source[i]] += len(x)
    shares = defaultdict(Counter)
    for p in pieces:
        shares[p["sequence_id"] // 8][source[p["doc_id"]]] += p["length"]
    everything = sum(total.values())
    for window in list(shares.values())[:-1]:
        for s in total:
            assert abs(window[s] / sum(window.values()) - total[s] / everything) < 0.05


def test_rare_source_has_no_empty_pieces(spark):
    """Ten tokens beside 40,000 in windows of 64: 626 windows, of which ten hold a token of the rare source."""
    rows = [(0, 0, "rare", 7), (1, 1, "rare", 3), *[(i, i, "large", 400) for i in range(2, 102)]]
    pieces = packing.placed(spark.createDataFrame(rows, "row long, doc_id long, key string, n long"), 32, 64).collect()
    assert min(r["length"] for r in pieces) == 1 and sum(r["length"] for r in pieces) == 40_010
    at = sorted(r["sequence_id"] * 32 + r["offset"] for r in pieces if r["row"] < 2)
    assert len(at) == 10 and all(r["length"] == 1 for r in pieces if r["row"] < 2)
    assert max(b - a for a, b in zip(at, at[1:], strict=False)) < 4_200  # spread over the whole row
    filled = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert all((s * 32 + o + n) == (t * 32 + p) for (s, o, n), (t, p, _) in zip(filled, filled[1:], strict=False))
    for row in (0, 1):
        starts = sorted(r["start"] for r in pieces if r["row"] == row)
        assert starts == list(range(len(starts)))


def test_words_cache_gives_the_tokenizers_ids(encode):
    rng = random.Random(9)
    pieces = [" ", "  ", "\n", "\t", "word", "Über", "don't", "123", "|", "<|endoftext|>", " ", " ", "é", "\x1c", "\x85", "x", ".", "語", "​"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 15))) for _ in range(4000)]
    words = packing.Words(packing.tokenizer_file())
    got = words.encode(texts)
    assert [np.frombuffer(g, words.kind).tolist() for g in got] == [encode(t)[:-1] for t in texts]


def test_packing_rows(docs, nothing, encode):
    once = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    pieces = packing.pack(once).collect()
    check_packing(pieces, {r["doc_id"]: encode(r["text"] or "") for r in once.collect()})
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(len(encode(r["text"] or "")) for r in docs.collect())
    assert packing.pack(nothing).count() == 0


def test_join_moves_and_keeps_no_more_than_it_needs(spark, monkeypatch):
    """Shingles are not kept on disk, whole rows that are met once are not dealt anew, and joins without broadcasts find the same."""
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1:]]) for k in (0, 59)]
    rows = [(9, " ".join(base)), (4, near[0]), (7, near[1]), (7, near[1]), (2, "other words stand here alone"), (5, near[0]), (8, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, real = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df: kept.append(df.columns) or real(df))
    found = jaccard_join.one_of_each(docs)
    assert kept and not any("shingles" in columns for columns in kept)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "BroadcastHashJoin" in plan
    want = sorted(map(str, found.collect()))
    assert sorted(map(str, [r["doc_id"] for r in found.collect()])) == ["2", "4", "8", "None"]
    monkeypatch.setattr(jaccard_join, "FEW", -1)
    monkeypatch.setattr(jaccard_join, "FEW_NODES", -1)
    assert sorted(map(str, jaccard_join.one_of_each(docs).collect())) == want


def test_few_nodes_take_few_tasks(spark, monkeypatch):
    dealt, real = [], jaccard_join.durable
    monkeypatch.setattr(jaccard_join, "durable", lambda df: dealt.append(real(df)) or dealt[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30)], "a long, b long")
        assert {tuple(r) for r in jaccard_join.components(links).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (40, 30)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(x.rdd.getNumPartitions() <= 16 for x in dealt[2:])


def bits_apart(x, y):
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


@pytest.mark.parametrize("size", [1100, 2040, 5000])
def test_wide_sketches_bound_long_sets(size):
    """They fold into narrower ones, never say more than the sets' difference, and tell sets apart for which SKETCH bits are too few."""
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
    wide = jaccard_join.wide_sketch(a)
    assert wide.size * 64 >= len(a)
    while wide.size * 64 > jaccard_join.SKETCH:
        wide = wide[:wide.size // 2] ^ wide[wide.size // 2:]
    assert wide.tolist() == jaccard_join.bit_sketch(a).tolist() and jaccard_join.wide_sketch(a[:jaccard_join.SKETCH]) is None
    for change in (3, size // 10, size // 2):
        b = np.concatenate([a[change:], rng.integers(1, 1 << 63, change, dtype=np.uint64)])
        x, y = jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b)
        assert bits_apart(x, y) <= 2 * change
    allowed = 20 * 2 * size / 180
    assert bits_apart(x, y) > allowed  # half of b is not in a
    assert size < 5000 or bits_apart(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= allowed


def test_only_likely_pairs_fetch_sets(spark):
    """Long texts that share a key but too few shingles are told apart before their shingles are dealt; linked ones of other widths are found."""
    texts = [[f"w{i}" for i in range(5000)], [f"w{i}" for i in range(2500)] + [f"v{i}" for i in range(2500)], [f"w{i}" for i in range(4000)]]
    sets = [jaccard_join.shingle_set(" ".join(t).encode()) for t in texts]
    rows = [(i, len(s), jaccard_join.bit_sketch(s).tolist(), jaccard_join.wide_sketch(s).tolist()) for i, s in enumerate(sets)]
    assert len(rows[0][3]) == 2 * len(rows[2][3])
    sizes = lineage.stored(spark.createDataFrame(rows, "set long, n_shingles long, sketch array<long>, wide array<long>"))
    shingles = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "set long, shingles array<long>")
    fetched = []

    def sets_of(needed):
        fetched.extend(r["set"] for r in needed.collect())
        return shingles.join(needed, "set", "left_semi")

    links = jaccard_join._verified(spark.createDataFrame([(0, 1), (2, 0), (1, 2)], "a long, b long"), sizes, sets_of, 79, 100)
    assert [tuple(r) for r in links.collect()] == [(2, 0)] and sorted(fetched) == [0, 2]


def test_join_leaves_no_tables_behind(spark, docs):
    """Tables that the join works with are deleted, also its keys, while what it returns can still be read."""
    folder = lineage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = jaccard_join.join_alike(docs)
    left = [f for f in set(os.listdir(folder)) - before if f.startswith("table-")]
    assert len(left) == 1 and found.count() == docs.count() and found.columns == ["doc_id", "n_shingles", "component_id"]


def shuffle_files(spark):
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


@pytest.mark.parametrize("write", [lineage.stored, lineage.durable])
def test_written_tables_leave_no_shuffle_files(spark, write):
    """They go when the table is written, not when the driver's garbage is collected; the session's setting stays."""
    dealt = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(lineage.FREED, None)
    table = write(dealt)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(lineage.FREED, None) == setting
    assert sum(r["count"] for r in table.collect()) == 1000
