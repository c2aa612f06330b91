"""Session logs: one file per case, one expectation per case."""
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import lenses, mining
from turnwise.operators.chunks import chunk_assign
from turnwise.operators.ordered import carry, int_segment
from turnwise.plans import jobs
from turnwise.sources import sessions
from turnwise.streaming import live

SHIPPED = {"polish": "design", "smash": "engineering"}


def user(text):
    return json.dumps({"type": "user", "message": {"content": text}})


def said(text):
    return json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}})


def tool(name, side=False, **args):
    line = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": args.pop("id", "t1"), "name": name, "input": args}]}}
    if side:
        line["isSidechain"] = True
    return json.dumps(line)


def result(text, id="t1"):
    return json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": id, "content": text}]}})


def command(name):
    return user(f"<command-name>{name}</command-name>")


ANSWER = said("Running it")
FORM = tool("AskUserQuestion", id="q1", questions=[])


def answered(text):
    return result(f'Your questions have been answered: "Which?"="{text}". You can now continue.', "q1")


@pytest.fixture
def log(spark, tmp_path):
    def write(*lines, project="-proj", name="abcdef12-3456", end="\n"):
        folder = tmp_path / "logs" / project
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + end, encoding="utf-8")
        return str(tmp_path / "logs")
    return write


def report(spark, root, skill=None, **options):
    raw, events = jobs.log_tables(spark, root, **options)
    return raw, jobs.correction_report(events, skill)


def hits(df):
    return [(r.kind, r.user) for r in df.orderBy("session", "seq", "part", "pos").collect()]


def test_base(spark, log):
    root = log(said("Should I add a retry?"), user("no, I already said we fix the source"), ANSWER,
               user("[Request interrupted by user]"), '{"type":"user","message":{"content":"half writ', end="")
    raw, found = report(spark, root)
    assert [k for k, _ in hits(found)] == ["REPLY", "INTERRUPT"]
    row = found.where("kind = 'REPLY'").first()
    assert (row.session, row.project, row.before) == ("abcdef12", "-proj", "Should I add a retry?")
    stats = mining.mining_stats(raw, found).first()
    assert (stats.files, stats.hits, stats.bad_lines) == (1, 2, 1)


@pytest.mark.parametrize("start", [tool("Skill", skill="x:polish"), tool("Skill", skill="polish"), command("/polish"), command("/x:polish")])
def test_skill_forms(spark, log, start):
    _, found = report(spark, log(start, ANSWER, user("no, wrong easing")), "x:polish")
    assert hits(found) == [("REPLY", "no, wrong easing")]


CASES = {
    "before": ([ANSWER, user("no, before the skill"), tool("Skill", skill="polish")], []),
    "switched": ([tool("Skill", skill="polish"), ANSWER, user("no, mid"), tool("Skill", skill="smash"), ANSWER, user("no, after")], ["no, mid"]),
    "switched by command": ([tool("Skill", skill="polish"), command("/smash"), ANSWER, user("no, after")], []),
    "never": ([ANSWER, user("no, nothing ran")], []),
    "kinds": ([tool("Skill", skill="polish"), ANSWER, user("[Request interrupted by user]")], ["[Request interrupted by user]"]),
    "junk": ([tool("Skill", skill="polish"), "not json at all", ANSWER, user("no, still found"), "5"], ["no, still found"]),
}


@pytest.mark.parametrize("name", CASES)
def test_span(spark, log, name):
    lines, want = CASES[name]
    assert [u for _, u in hits(report(spark, log(*lines), "polish")[1])] == want


@pytest.mark.parametrize("text,n", [("Ship it (Recommended)", 0), ("smash (Recommended), grill upgrades", 1), ("keep it in notion", 1)])
def test_answers(spark, log, text, n):
    found = hits(report(spark, log(FORM, answered(text)))[1])
    assert [k for k, _ in found] == ["ASK"] * n


def test_rejected_and_reused_id(spark, log):
    root = log(tool("AskUserQuestion", id="q1", questions=["one"]), tool("AskUserQuestion", id="q1", questions=["two"]),
               answered("mine"), result("The user doesn't want to proceed", "t9"))
    found = report(spark, root)[1].orderBy("seq").collect()
    assert [r.kind for r in found] == ["ASK", "REJECTED"]
    assert "two" in found[0].before


def test_peer_hook_and_filters(spark, log):
    root = log(said("Should I continue?"), user("Another Claude session sent a message:\nno, stop that"),
               user("<tag>no"), user("no " + "x" * 2500), user("   "), user("Stop hook feedback:\nnot satisfied"))
    found = report(spark, root)[1].collect()
    assert [(r.kind, r.before) for r in found] == [("HOOK", "Should I continue?")]


def test_resumed_session_counts_once(spark, log):
    lines = [ANSWER, user("no, I already said we fix the source")]
    log(*lines)
    root = log(*lines, name="resumed0")
    found = report(spark, root)[1]
    assert [r.session for r in found.collect()] == ["abcdef12"]
    again = mining.dedupe_exchanges(found)
    assert again.count() == found.count()


def test_project_private_and_since(spark, log):
    lines = [ANSWER, user("no, wrong")]
    log(*lines, project="-a")
    log(*lines, project="-x-private-y")
    root = log(*lines, project="-b")
    assert sessions.read_sessions(spark, root).select("project").distinct().count() == 2
    assert [r.project for r in report(spark, root, project="b")[1].collect()] == ["-b"]
    assert sessions.read_sessions(spark, root, since="2999-01-01").count() == 0


def test_null_content_and_headless(spark, log):
    head = json.dumps({"type": "user", "entrypoint": "sdk-cli", "message": {"content": None}})
    log(head, ANSWER, user("no, headless"), name="headless")
    root = log(ANSWER, user("no, typed"))
    assert [u for _, u in hits(report(spark, root, headless=False)[1])] == ["no, typed"]
    assert len(hits(report(spark, root)[1])) == 2


def test_turns(spark, log):
    root = log(user("add the export button"), tool("Bash", command="npm run lint"), tool("Skill", skill="release-notes"),
               tool("Bash", side=True, command="sidechain-only"), said("Done, the tests pass."), user("great, thanks"), ANSWER)
    _, events = jobs.log_tables(spark, root)
    rows = jobs.turn_table(events).orderBy("turn_id").collect()
    assert [(r.user, r.tools, r.claude) for r in rows] == [
        ("add the export button", ["Bash npm run lint", "Skill release-notes"], "Done, the tests pass."),
        ("great, thanks", [], "Running it")]


def test_line_order_over_splits(spark, log):
    root = log(*[user(f"no {i}") for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = sessions.read_sessions(spark, root).select("seq", F.get_json_object("value", "$.message.content").alias("t")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.t for r in rows] == [f"no {i}" for i in range(3000)]
    assert len({r.seq for r in rows}) == 3000


def test_segments_do_not_change_running_state(spark):
    rows = spark.createDataFrame([(i % 3, i, None if i % 7 else i, i % 5) for i in range(2000)], "k int, seq long, v int, n int")
    def scan(bits):
        out = carry(rows, ["k"], ["seq"], int_segment("seq", bits), last={"l": F.col("v")}, prior={"p": F.col("v")},
                    total={"s": F.col("n")}, best={"b": F.col("n")})
        return sorted(tuple(r) for r in out.collect())
    assert scan(3) == scan(30)


def test_scorecard(spark, log):
    root = log(tool("Skill", skill="design:polish"), user("no, wrong"), result("rejected by the user"), user("Stop hook feedback: x"),
               tool("Skill", skill="other:polish"), user("no, not counted"))
    _, events = jobs.log_tables(spark, root)
    rows = jobs.skill_scorecard(events, SHIPPED).collect()
    assert [(r.skill, r.n) for r in rows] == [("polish", 3)]
    told = spark.createDataFrame([("abcdef12", "polish")], "session string, skill string")
    assert jobs.skill_scorecard(events, SHIPPED, told).count() == 0


def test_stream_equals_batch(spark, log):
    log(tool("Skill", skill="design:polish"), user("no, wrong"), user("nope"))
    root = log(tool("Skill", skill="smash"), user("why this"), "junk", name="second00", project="-q")
    _, events = jobs.log_tables(spark, root)
    batch = {(r.session, r.skill, r.n) for r in mining.corrections_by_skill(events, SHIPPED).collect()}
    marks = live.correction_marks(sessions.events(sessions.stream_sessions(spark, root)), SHIPPED)
    assert {(r.session, r.skill, r.n) for r in live.stream_corrections(marks).collect()} == batch


MARKS = "session string, seq long, skill string, hits long"


def test_corrections_do_not_depend_on_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i % 4}", i, rng.choice([None, None, "a", "b", ""]), rng.randint(0, 2)) for i in range(60)]
    want = {tuple(r) for r in live.corrections_so_far(spark.createDataFrame(rows, MARKS)).collect()}
    for name, cuts in (("one", [rows]), ("many", [rows[i:i + 15] for i in range(0, 60, 15)]), ("shuffled", [rows[i::4] for i in (2, 0, 3, 1)])):
        src = str(tmp_path / name)
        for cut in cuts:  # written one after the other, so read in this order
            spark.createDataFrame(cut, MARKS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(MARKS).option("maxFilesPerTrigger", 1).parquet(src)
        assert {tuple(r) for r in live.stream_corrections(stream).collect()} == want, name


def test_late_rows_and_pauses(spark, tmp_path):
    src, schema = str(tmp_path / "src"), MARKS
    spark.createDataFrame([("a", 5, "polish", 0), ("a", 6, None, 1)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    folders = str(tmp_path / "week"), str(tmp_path / "none")
    assert [tuple(r) for r in live.stream_corrections(stream, folders[0]).collect()] == [("a", "polish", 1)]
    live.stream_corrections(stream, folders[1])
    spark.createDataFrame([("a", 2, "smash", 0), ("a", 3, None, 1), ("a", 7, None, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    assert {tuple(r) for r in live.stream_corrections(stream, folders[0]).collect()} == {("a", "smash", 1), ("a", "polish", 2)}
    assert {tuple(r) for r in live.stream_corrections(stream, folders[1], ttl="0 seconds").collect()} == {("a", "smash", 2)}


# --- lenses: each with a decoy that must stay out ------------------------------------------------
def test_no_artifact_with_decoy(spark, log):
    for i in range(3):
        log(user("fix it"), tool("Edit", file_path="a.ts"), said("Fixed. All tests pass now."), name=f"case{i}000")
    root = log(user("fix it"), tool("Bash", command="npm test"), said("Fixed. All tests pass now."), name="decoy000")
    _, events = jobs.log_tables(spark, root)
    found = lenses.no_artifact_claim(events)
    assert sorted(r.session for r in found.collect()) == ["case0000", "case1000", "case2000"]
    assert [(r.sessions, len(r.quotes)) for r in lenses.recurring(found).collect()] == [(3, 3)]


def test_missed_trigger_with_decoy(spark, log):
    ask = "write the release notes for this version please"
    for i in range(3):
        log(user(ask), said("Here they are"), name=f"case{i}000")
    root = log(user(ask), tool("Skill", skill="release-notes"), said("ok"), user("rename a variable"), name="decoy000")
    _, events = jobs.log_tables(spark, root)
    triggers = spark.createDataFrame([(1, "release-notes", "write the release notes"), (2, "deploy", "deploy the app to production")],
                                     "trigger long, skill string, query string")
    found = jobs.missed_triggers(events, triggers).collect()
    assert sorted(r.skill for r in found) == ["release-notes"] * 3
    assert not any(r.request.file.endswith("decoy000.jsonl") for r in found)


def test_other_lenses(spark, log):
    trace = "\n".join(["Look at this:", "Traceback (most recent call last)"] + [f"  line {i}" for i in range(8)])
    log(user(trace), tool("Grep", description="find the config"), said("Lint is clean."), name="a0000000")
    root = log(user("go"), tool("Grep", description="find  the CONFIG"), *[tool("Bash", command="ls")] * 3, tool("Bash", command="npm run lint"),
               said("Lint is clean."), name="b0000000")
    _, events = jobs.log_tables(spark, root)
    found = {(r.lens, r.session) for r in jobs.lens_findings(events).collect()}
    assert found == {("pasted context", "a0000000"), ("skipped check", "a0000000"), ("rediscovered", "b0000000"), ("wasted calls", "b0000000")}


# --- chunks -------------------------------------------------------------------------------------
def greedy(sizes, n):
    out, held, chunk = [], 0, 0
    for i, s in enumerate(sizes):
        if i and held >= n:
            chunk, held = chunk + 1, 0
        out.append(chunk)
        held += s
    return out


@pytest.mark.parametrize("n", [1, 6, 17, 1000])
def test_chunks_match_the_greedy_cut(spark, n):
    sizes = [(i * 7919) % 11 + 1 for i in range(200)]
    rows = [(p, f"{i:04d}", s) for p in ("a", "b") for i, s in enumerate(sizes)]
    got = chunk_assign(spark.createDataFrame(rows, "project string, session string, lines int"), n).orderBy("project", "session").collect()
    assert [r.chunk for r in got] == greedy(sizes, n) * 2


def test_chunks_refuse_zero(spark):
    with pytest.raises(ValueError):
        chunk_assign(spark.range(1), 0)


def test_export_reassembles(spark, log, tmp_path):
    for s in ("aaaa1111", "bbbb2222", "cccc3333"):
        root = log(ANSWER, user(f"no, first in {s}"), ANSWER, user(f"no, second in {s}"), name=s)
    _, events = jobs.log_tables(spark, root)
    out = str(tmp_path / "chunks")
    ranges = jobs.export_chunks(jobs.correction_report(events), 6, out).orderBy("chunk").collect()
    assert [(r.first_line, r.last_line, r.sessions) for r in ranges] == [(1, 8, 1), (9, 16, 1), (17, 24, 1)]
    text = "\n".join(r.value for r in spark.read.option("recursiveFileLookup", "true").text(out).collect())
    assert text.count("### REPLY") == 6
    folders = sorted(p.name for p in (tmp_path / "chunks").iterdir() if p.is_dir())
    assert folders == ["chunk=-proj.000000", "chunk=-proj.000001", "chunk=-proj.000002"]
