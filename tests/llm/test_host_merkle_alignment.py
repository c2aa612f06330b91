"""Host rules, Merkle manifest and token alignment against plain Python."""
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from tests.llm.conftest import SF
from turnwise import llm
from turnwise.llm import alignment, host_rules, merkle

SPACE = str.maketrans("\t\n\x0b\x0c\r", " " * 5)


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_merkle"])
def test_sql(spark, name):
    status, _, _, note = compare(spark, connect(SF), name, llm.QUERIES[name], llm.ORACLES[name], SF)
    assert status == "ok", note


# host rules

def plain_measure(text):
    text = text or ""
    words = [w for w in text.translate(SPACE).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    held = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.translate(SPACE).strip(" ")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(held))


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "a b c", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nq", "é é # $|<> \x1f\x85", "one two three four one two three\none two three", "#" * 50,
])
def test_measure(text):
    assert host_rules.measure(text or "") == plain_measure(text)


def test_measure_of_a_very_long_text():
    n = 400_000
    words, *_, held = host_rules.measure(" ".join(f"w{i}" for i in range(n)) + " w0 w1 w2")
    assert (words, held) == (n + 3, 6)


def host_rows():
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "good", good) for i in range(40)] + [(100 + i, "bad", good if i < 4 else "short") for i in range(40)]
    return rows + [(200, "small", "short"), (204, "small", good), (201, None, good), (None, "good", good), (3, "good", good), (202, "bad", None), (203, None, "")]


def test_host_verdicts(spark):
    got = host_rules.judge(spark.createDataFrame(host_rows(), "doc_id int, host string, text string").withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(host_rows())
    for r in got:
        assert r["host_failed"] == (r["host"] == "bad") and r["base_failed"] == (r["n_words"] < 50)
        assert r["kept"] == (not r["base_failed"] and r["host"] != "bad")


def test_shrinking(spark):
    """The prior of hosts that differ is weak, that of hosts that are alike is strong; a small host moves towards the others."""
    hosts = spark.createDataFrame(host_rows(), "doc_id int, host string, text string")
    rates = {r["host"]: r for r in host_rules.host_rates(host_rules.host_failures(host_rules.measured(hosts))).collect()}
    assert 0 < rates["small"]["r_few_words"] < 1 and rates["bad"]["r_few_words"] > rates["small"]["r_few_words"] > rates["good"]["r_few_words"] > 0
    alike = host_rules.beta_prior(100, 1000, 10000.0, 300, 100 * 9 / 10)
    assert sum(alike) > 1e5 and abs(alike[0] / sum(alike) - 0.3) < 1e-9
    apart = host_rules.beta_prior(100, 1000, 10000.0, 500, 50 * 10.0)
    assert sum(apart) < 0.01


def test_host_limit_and_rules(spark):
    rows = spark.createDataFrame(host_rows(), "doc_id int, host string, text string")
    one = {"few_words": host_rules.BASE["few_words"]}
    assert host_rules.judge(rows, one, limit=1.0).where("host_failed").count() == 0
    assert {r["host"] for r in host_rules.judge(rows, one, limit=0.0).where("host_failed").collect()} == {"good", "bad", "small"}


def test_host_rules_on_odd_rows(spark, docs, nothing):
    renamed = docs.withColumnRenamed("source", "host")
    got = host_rules.judge(renamed).collect()
    assert sorted(map(repr, ((r["doc_id"], *[r[c] for c in host_rules.COUNTS]) for r in got))) == sorted(
        repr((r["doc_id"], *plain_measure(r["text"]))) for r in renamed.collect())
    assert host_rules.judge(nothing.withColumnRenamed("source", "host")).count() == 0


# Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_paths(nodes):
    """Root of the nodes, and the (before, after) siblings of each."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[(r["lang"] is not None, (r["lang"] or "").encode())].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    for members in trees.values():
        members.sort(key=lambda m: m[:3])
    roots = {k: plain_paths([m[2] for m in v]) for k, v in trees.items()}
    root, tops = plain_paths([roots[k][0] for k in sorted(roots)])
    out = []
    for key, top in zip(sorted(roots), tops, strict=True):
        for (_, _, leaf, r), path in zip(trees[key], roots[key][1], strict=True):
            odd = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            at = plain_leaf(r, int(odd))
            for before, after in path + top:
                at = sha(before, at, after)
            out.append((r["doc_id"], leaf, roots[key][0], root, sha(*[b + a for b, a in path + top]), at, at == root))
    return sorted(out, key=repr)


def manifest_rows(frame, step=merkle.STEP):
    return sorted((tuple(r) for r in merkle.verify_documents(frame, step).collect()), key=repr)


@pytest.mark.parametrize("step", [1, 2, 3, 8])
def test_manifest_at_any_step(spark, plain, step):
    """What is persisted changes nothing: proofs from every level, every second, and so on are the same."""
    rows = [r for r in plain.values() if r["doc_id"] < 120]
    assert manifest_rows(spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5), step) == plain_manifest(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 9])
def test_manifest_of_one_language(spark, count):
    rows = spark.createDataFrame([(i, "x", "en", "s", 1) for i in range(count)], "doc_id int, text string, lang string, source string, n_chars int")
    assert manifest_rows(rows, 1) == plain_manifest(rows.collect())


def test_manifest_of_odd_rows(spark, docs, nothing):
    odd = docs.withColumns({"pos": F.lit(1), "hash": F.lit(2), "tree": F.lit(3)}).unionByName(
        docs.withColumns({"pos": F.lit(1), "hash": F.lit(2), "tree": F.lit(3), "lang": F.lit(None).cast("string")}))
    assert manifest_rows(odd, 2) == plain_manifest(odd.collect())
    assert manifest_rows(nothing) == []


def test_proofs_are_general(spark):
    """Any rows with a tree and a hash have proofs; other columns stay."""
    rows = spark.createDataFrame([(t, f"{t}{i}", i, {"k": i}) for t in "ab" for i in range(21)], "tree string, hash string, at int, extra map<string,int>")
    got = merkle.manifest(rows, ["at"], 2).select("*", merkle.fold_proof(F.col("hash"), F.col("before"), F.col("after")).alias("up")).collect()
    assert len(got) == 42 and all(r["up"] == r["root"] and r["pos"] == r["at"] and r["extra"] == {"k": r["at"]} for r in got)


# token alignment

def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in second.encode(text or ""):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links, j = [], 0
        for i, s, e in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            links += [(i, k) for k, x, _ in spans[1][j:j + e - s + 1] if x < e]
        cuts = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        halves = [[[]], [[]]]
        for half, side in zip(halves, spans, strict=True):
            for i, _, e in side:
                half[-1].append(str(i))
                if e in cuts:
                    half.append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*halves, strict=True)][:-1]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(link for d in docs for link in d[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(a, b, g, len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), sha) for a, b, g, x, sha in docs]


def aligned_rows(frame, **options):
    got = alignment.align_tokens(frame, **options).collect()
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got), key=repr)


def expected(rows):
    return sorted(((r["doc_id"], *x) for r, x in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True)), key=repr)


@pytest.mark.parametrize("options", [{}, {"chunk": 500, "block": 2000}, {"chunk": 1, "block": 1}])
def test_alignment(spark, plain, options):
    """The same in any cut into chunks and blocks."""
    rows = [r for r in plain.values() if len(r["text"] or "") < 1500][:60]
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert aligned_rows(frame, **options) == expected(rows)


TEXTS = [
    None, "", " ", "a", "\n\n", "  two  spaces ", "<|endoftext|> plain <s> </s> <unk> <0x41>", "日本語のテキスト🙂 mixed", "tab\tand   nbsp", "▁ marks ▁", "nul \x00 byte",
    "é and é ﬁ", "﻿bom", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "don't I'LL we've 123456 3.14", "  line", "ends in space ",
]


def test_alignment_of_odd_texts(spark, nothing):
    frame = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a")], "doc_id int, text string").withColumn("block", F.lit(9))
    assert aligned_rows(frame) == expected(frame.collect())
    assert aligned_rows(nothing) == []


def test_alignment_of_a_very_long_text(spark, docs):
    rows = [r for r in docs.collect() if len(r["text"] or "") > 100_000]
    got = aligned_rows(docs.where(F.length("text") > 100_000), chunk=1000)
    assert [r[:4] for r in got] == [(d, a, b, g) for d, a, b, g, *_ in expected(rows)] and [r[7] for r in got] == [r[7] for r in expected(rows)]
