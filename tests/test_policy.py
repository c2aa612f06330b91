"""Modes, gates, paths, notes and hooks."""
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions import calls as c
from turnwise.functions import text as tx
from turnwise.operators import chains, policy, prose
from turnwise.operators.changes import is_test_path
from turnwise.streaming import live


def judge(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("out", fn(F.col("v")))
    return [r.out for r in rows.orderBy("i").collect()]


COMMANDS = {
    "ls -la": "readonly", 'echo "a > b"': "readonly", "echo 'a > b'": "readonly", "echo \\> b": "readonly",
    'echo "a > b': "build", "cat x > notes.md": "research", "cat x >> NOTES.MD": "research", "x > .claude/work/t/a": "prototype",
    "x > a.md > b.ts": "build", "x > .claude/work/a; y > n.md": "prototype", "ls 2>&1": "readonly", "ls > /dev/null": "readonly",
    "ls 2> /dev/null": "readonly", "git commit -m x": "research", "git commit -m x && git push": "off", "gh pr create": "off",
    "gh pr view": "readonly", "gh api repos/x/pulls -X POST": "off", "gh api repos/x/pulls -f title=x": "off",
    "gh api repos/x/pulls -X GET -f a=b": "readonly", "gh api repos/x/pulls": "readonly", "gh issue create -t x": "research",
    "acli jira workitem create": "research", "a \\\n > q": "build", 'echo "\\"a > b"': "readonly", "echo 'it' > x.md | tee y": "research",
}


def test_command_needs(spark):
    got = judge(spark, COMMANDS, lambda v: c.mode_name(c.strictest_need(v)))
    assert dict(zip(COMMANDS, got)) == COMMANDS


TOOLS = {
    "mcp__s__create_issue": "research", "mcp__s__createIssue": "research", "mcp__s__get_issue": "readonly", "mcp__s__push_files": "off",
    "mcp__s__create_pull_request": "off", "mcp__s__list_pull_requests": "readonly", "mcp__s__get_pull_request": "readonly",
    "mcp__ccd_turn__set_x": "readonly", "mcp__ccd_pr__set_x": "research", "Grep": "readonly", "mcp__a.b__batch-edit": "research",
}


def test_tool_needs(spark):
    got = judge(spark, TOOLS, lambda v: c.mode_name(c.mcp_need(v)))
    assert dict(zip(TOOLS, got)) == TOOLS


def test_required_mode_of_other_tools(spark):
    rows = [("Write", None, "a/b.md", None, 1), ("Edit", None, "a/.claude/work/x.html", None, 2), ("NotebookEdit", None, "a.ipynb", None, 3),
            ("Artifact", None, None, "list", 0), ("Artifact", None, None, "publish", 1), ("Artifact", None, None, None, 1), ("Bash", None, None, None, 0)]
    out = policy.with_need(spark.createDataFrame(rows, "tool string, command string, path string, action string, want int")).collect()
    assert [r.need for r in out] == [r.want for r in out]


WORKING = {  # a path and the rule that catches it; each with one that just misses it
    "site/prototypes/v2.html": 0, ".scratch/try.py": 0, "lib/spike-cache/go.mod": 0, "notes.local/today.md": 0, "site/prototype/v2.html": None, "lib/pike-cache/go.mod": None,
    "reports/may.csv": 1, "docs/epics/login.md": 1, "docs/guide/login.md": None, "lib/reports/may.csv": None,
    "ci/test-results/run.xml": 2, "ci/results/run.xml": None,
    "ideas.txt": 3, "plan.html": 3, "Readme.md": None, "LICENSE.txt": None, "lib/ideas.txt": None,
    "lib/31-OUTCOME.md": 4, "lib/summary.md": 4, "lib/31-outcome.md": None, "lib/summary.rst": None,
    "tests/zz-probe-1.js": 5, "load_tmp.py": 5, "tests/probe-zz-1.js": None, ".github/reports/x.md": None,
}


def test_working_files(spark):
    got = judge(spark, list(WORKING), c.working_file_reason)
    assert dict(zip(WORKING, got)) == {path: None if rule is None else lx.PATH_REASONS[rule] for path, rule in WORKING.items()}


def test_allow_list(spark):
    rows = [("path/prefix/x.md", ["path/prefix/"], True), ("glob/a/b.md", ["glob/**/*.md"], True), ("glob/b.md", ["glob/**/*.md"], True),
            ("a.b/c", ["a?b/*"], False), ("axb", ["a.b"], False), ("a/b/c", ["a/*"], False), ("a/b/c", ["a/**"], True), ("x", None, False)]
    out = spark.createDataFrame(rows, "rel string, allow array<string>, want boolean").withColumn("got", c.path_allowed(F.col("rel"), F.col("allow")))
    assert [r.got for r in out.collect()] == [r[2] for r in rows]


def test_test_and_migration_paths(spark):
    tests = {"a/b.test.ts": True, "a/test_x.py": True, "x_test.go": True, "tests/a.txt": True, "a\\tests\\b": True, "tests": False, "contest/a.py": False}
    assert dict(zip(tests, judge(spark, tests, is_test_path))) == tests
    moves = {"app/database/migrations/x.php": True, "drizzle/0001_a/m.sql": True, "drizzle/meta/j.json": True, "shop/migrations/0001_x.py": True,
             "shop/migrations/readme.md": False, "drizzle/schema.ts": False}
    assert dict(zip(moves, judge(spark, moves, c.migration_path))) == moves


def test_resolve_path(spark):
    got = judge(spark, ["a/../b/./c", "/x//y/..", "../../z"], lambda v: c.resolve_path(v, F.lit("/h/w")))
    assert got == ["/h/w/b/c", "/x", "/z"]


def test_shift_edges(spark):
    at = ["2024-01-01 09:00:00", "2024-01-01 17:59:59", "2024-01-01 18:00:00", "2024-01-01 08:59:00"]
    ts = lambda v: v.cast("timestamp")
    assert judge(spark, at, lambda v: c.in_shift(ts(v))) == [True, True, False, False]
    assert judge(spark, at, lambda v: c.in_shift(ts(v), "9:00", "18:00")) == [True, True, False, False]
    night = ["2024-01-01 22:00:00", "2024-01-01 05:59:00", "2024-01-01 06:00:00", "2024-01-01 12:00:00"]
    assert judge(spark, night, lambda v: c.in_shift(ts(v), "22:00", "06:00")) == [True, True, False, False]
    assert judge(spark, ["2024-01-01 12:35:00", "2024-01-01 01:00:00"], lambda v: c.in_shift(ts(v), zone="Asia/Manila")) == [False, True]


def test_gate(spark):
    rows = [("Read", 12, None, True, "pass"), ("mcp__x__save_issue", 20, None, True, "deny"), ("mcp__x__save_issue", 12, "Done", True, "pass"),
            ("mcp__x__save_issue", 12, "Canceled", True, "ask"), ("mcp__x__delete_comment", 12, None, True, "ask"),
            ("mcp__x__delete_comment", 12, None, False, "pass"), ("mcp__x__update_thing", 20, None, True, "pass"),
            ("mcp__linear-server__update_thing", 20, None, True, "deny")]
    df = spark.createDataFrame([(t, dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc), s, f, w) for t, h, s, f, w in rows],
                               "tool string, ts timestamp, state string, has_surface boolean, want string")
    assert [r.verdict for r in policy.shift_verdict(df).collect()] == [r[4] for r in rows]
    ask = policy.shift_verdict(df, on_shift="ask").collect()
    assert ask[2].verdict == "ask" and policy.shift_verdict(df, on_shift="host").collect()[3].verdict == "pass"


EDGES = [("a", "main"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")]
MODES = [("a", "subagents", "research"), ("main", "subagents", "build"), ("x", "subagents", "readonly"), ("b", "self", "prototype"), ("c", "self", "off")]


def refused_by(held, agent, need):
    """Whose mode refuses a call: the user's, the agent's own or that of an agent above it."""
    if need > held["user"]:
        return "user"
    if need > held["self"].get(agent, 4):
        return "own"
    above, at = set(), held["parent"].get(agent)
    while at is not None and at != agent and at not in above:
        above.add(at)
        at = held["parent"].get(at)
    return "above" if any(need > held["subagents"].get(a, 4) for a in above) else None


ACTIONS = "session string, seq long, kind string, agent string, scope string, parent string, rank int"


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_follow_each_event(spark, seed):
    """Modes and parents that change in time, agents below each other, cycles and unknown agents, against one event after the other."""
    rng = random.Random(seed)
    names, rows, want = ["main", "a", "b", "c", "d", None], [], set()
    for session in ("s", "t"):
        held = {"user": 4, "self": {}, "subagents": {}, "parent": {}}
        for seq in sorted(rng.sample(range(4 << 20), 150)):
            kind, agent, scope = rng.choice(["mode", "agent_mode", "spawn", "call", "call", "call"]), rng.choice(names), rng.choice(["self", "subagents"])
            parent, rank = rng.choice(names[:5]), rng.choice([1, 2, 3, 4, 4]) if kind != "call" else rng.randint(0, 4)
            rows.append((session, seq, kind, agent, scope, parent, rank))
            if kind == "mode":
                held["user"] = rank
            elif kind == "agent_mode":
                held[scope][agent] = rank
            elif kind == "spawn":
                held["parent"][agent] = parent
            else:
                by = refused_by(held, agent, rank)
                want.add((session, seq, agent, "deny" if by else "pass", by))
    got = live.verdicts_so_far(spark.createDataFrame(rows, ACTIONS).repartition(3))
    assert {tuple(r) for r in got.collect()} == want and {by for *_, by in want} >= {"user", "own"} | ({"above"} if seed < 2 else set())


def test_inherited_modes_and_stream_agree(spark):
    edges, modes = spark.createDataFrame(EDGES, "child string, parent string"), spark.createDataFrame(MODES, "agent string, scope string, mode string")
    got = {r.agent: r["rank"] for r in chains.inherited_mode(edges, modes).collect()}
    assert got == {"main": 4, "a": 3, "b": 1, "c": 1, "x": 4, "y": 0}
    ladder = ["readonly", "research", "prototype", "build", "off"]
    held = {"user": 4, "self": {}, "subagents": {}, "parent": dict(EDGES)}
    for agent, scope, mode in MODES:
        held[scope][agent] = ladder.index(mode)
    for agent, rank in got.items():
        for need in range(5):
            assert (refused_by(held, agent, need) is not None) == (need > rank)


def test_long_chain_needs_few_rounds(spark):
    links = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    far = chains.parent_chain(links).agg(F.max("depth").alias("d"), F.max("root").alias("r")).first()
    assert (far.d, far.r) == (4999, 0)


def test_decisions(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    edges = spark.createDataFrame([(1, 2, None), (2, 4, None), (3, 5, "price"), (6, 6, None)], "id int, superseded_by int, part string")
    got = chains.current_decision(ids, edges)
    assert {r.id: (r.current, r.hops) for r in got.collect()} == {1: (4, 2), 2: (4, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (None, None)}
    assert [tuple(r) for r in chains.replaced_parts(got, edges).collect()] == [(3, "price", 5)]


def test_reverts(spark):
    rows = [("a1", 1, "Add"), ("b2", 2, 'Revert\n\nThis reverts commit a1.'), ("c3", 3, 'Reapply\n\nThis reverts commit b2.'), ("d4", 4, "Add"),
            ("e5", 5, "This reverts commit d4.")]
    got = {r.sha: (r.root, r.live) for r in chains.revert_chain(spark.createDataFrame(rows, "sha string, ts int, message string")).collect()}
    assert got == {"a1": ("a1", True), "b2": ("a1", True), "c3": ("a1", True), "d4": ("d4", False), "e5": ("d4", False)}


def test_stack(spark):
    rows = [("s", "a", "ba", ["b"]), ("s", "b", "bb", []), ("s", "c", "bc", ["a", "b"]), ("s", "x", "bx", ["y"]), ("s", "y", "by", ["x"]), ("t", "z", "bz", ["gone"])]
    items = spark.createDataFrame(rows, "slice string, id string, branch string, blocked_by array<string>")
    got = {r.id: (r.slice, r.pos, r.base) for r in chains.stack_order(items).collect()}
    assert got == {"b": ("s", 1, "main"), "a": ("s", 2, "bb"), "c": ("s", 3, "ba"), "z": ("t", 1, "main"), "x": ("s", None, None), "y": ("s", None, None)}


def plain_levels(blocked_by):
    levels, state = {}, {}

    def level(i):
        """None in or above a cycle."""
        if state.get(i) == "open":
            return None
        if i not in levels:
            state[i] = "open"
            below = [level(b) for b in blocked_by[i] if b in blocked_by]
            levels[i] = None if None in below else max([x + 1 for x in below], default=0)
            state[i] = "done"
        return levels[i]
    for i in blocked_by:
        level(i)
    return levels


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_items(spark, seed):
    """Chains, trees and lattices at once, with and without cycles."""
    rng = random.Random(seed)
    blocked = {i: sorted({rng.randrange(max(0, i - rng.choice([1, 2, 20])), i) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) if i else [] for i in range(120)}
    if seed % 2:
        loop = {200: [201], 201: [202], 202: [200], 203: [200, 5], 204: [203], 205: [4, 300]}
        blocked |= loop
    got = chains.blocker_levels(spark.createDataFrame(list(blocked.items()), "id int, blocked_by array<int>"), plain=seed // 2)
    want = plain_levels(blocked)
    if seed % 2:
        want |= dict.fromkeys([200, 201, 202, 203, 204])
    assert {r.id: r.level for r in got.collect()} == want


def test_levels_of_a_long_chain(spark, monkeypatch):
    """5,000 items in a row, and two long arms that meet again, in few rounds."""
    rounds = []
    kept = chains.durable
    monkeypatch.setattr(chains, "durable", lambda df: rounds.append(1) or kept(df))
    rows = [(i, [i - 1] if i else []) for i in range(5000)] + [(9000, [4999, 10]), (9001, [9000]), (9002, [9001, 20])]
    got = {r.id: r.level for r in chains.blocker_levels(spark.createDataFrame(rows, "id int, blocked_by array<int>"), plain=4).collect()}
    assert got[4999] == 4999 and [got[i] for i in (9000, 9001, 9002)] == [5000, 5001, 5002] and len(rounds) < 60


# --- notes --------------------------------------------------------------------------------------
NOTES = {
    "Use pnpm, never npm: the lockfile is pnpm-lock.yaml.": None,
    "Currently migrating auth to OAuth; next step is the callback route.": "task state",
    "Fixed in PR #412.": "one-off reference", "Regression came from a1b2c3d.": "one-off reference", "See #88 for context.": "one-off reference",
    "Work lives on claude/doctor-prompt-audit.": "one-off reference", "The word deadbeefs is letters only: deadbeef.": None, "Call 5551234567.": None,
    "The retry lives in src/api/client.ts:42.": "repo detail", "Retry like this:\n```ts\nretry(3)\n```": "repo detail",
    "Navigate via `http://127.0.0.1:8000` (not `localhost:8000`).": None, "Setup is in `.claude/rules/server.local.md`.": None,
    "Wired to it since 2026-09-04.": "dated status", "As of 2026 the team is three people.": "dated status",
    "Full plan: `~/.claude/plans/clever.md`.": "short-lived", "Logs are in /tmp/build.log.": "short-lived",
    "It lives on branch feature/native-rewrite.": "short-lived", "First deploy still pending: needs login.": "short-lived",
    "Snapnames pending-delete candidates arrive without metadata.": None, "Buttons show a pending state while in flight.": None,
    "The user prefers small commits. " * 50: "topic length",
}


def test_note_rules(spark):
    rows = [(f"/m/{i}.md", "", t, True) for i, t in enumerate(NOTES)]
    found = prose.note_rules(spark.createDataFrame(rows, "path string, old string, new string, whole boolean")).collect()
    got = {r.path: r.rule for r in found}
    assert {t: got.get(f"/m/{i}.md") for i, t in enumerate(NOTES)} == NOTES


def test_note_edits_and_headers(spark):
    old = "- Currently on PR #12\n- Use pnpm"
    rows = [("/m/MEMORY.md", old, "- Use pnpm", False), ("/m/MEMORY.md", old, old + "\n- Use tabs", False),
            ("/m/x.md", "", "---\nmodified: 2026-10-11\n---\nUse pnpm.", True), ("/m/MEMORY.md", "a", "a\n" + "x" * 220, False)]
    found = prose.note_rules(spark.createDataFrame(rows, "path string, old string, new string, whole boolean")).collect()
    assert [r.rule for r in found] == ["index line"]
    paths = {"/a/projects/p/memory/x.md": True, "/a/projects/p/memory/x.txt": False, "/home/u/notes/x.md": True, "/home/v/notes/x.md": False}
    assert dict(zip(paths, judge(spark, paths, lambda v: prose.is_note_path(v, "~/notes", "/home/u")))) == paths


# --- hooks --------------------------------------------------------------------------------------
def test_overrides(spark):
    rows = [(0, "", None), (2, "", "denies"), (0, "[1]", None), (0, '{"decision":"block"}', "denies"),
            (0, json.dumps({"hookSpecificOutput": {"permissionDecision": "allow"}}), "approves"),
            (0, json.dumps({"hookSpecificOutput": {"permissionDecision": "deny"}}), "denies"), (1, "text", None)]
    df = spark.createDataFrame(rows, "code int, out string, want string")
    assert [r.g for r in df.select(c.hook_override(F.col("code"), F.col("out")).alias("g")).collect()] == [r[2] for r in rows]


def test_payload_text(spark):
    rows = {'{"a":{"b":["x","Before the PR, yes"]}}': "Before the PR", '{"Before the PR":1}': None, '{"a":"b:","q":"say \\"PASS VERDICT\\""}': "PASS VERDICT"}
    assert dict(zip(rows, judge(spark, rows, c.banned_payload_text))) == rows


def test_matchers(spark):
    actions = spark.createDataFrame([("A", "Edit"), ("B", "Bash"), ("C", "BashOutput")], "id string, tool string")
    got = {(r.id, r.hook) for r in policy.matcher_cross(actions, [("h1", "Edit|Bash"), ("h2", ""), ("h3", "Bash.*")]).collect()}
    assert got == {("A", "h1"), ("B", "h1"), ("A", "h2"), ("B", "h2"), ("C", "h2"), ("B", "h3"), ("C", "h3")}


def test_expiry_edges(spark):
    now = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    rows = [("at", now - dt.timedelta(days=1)), ("fresh", now - dt.timedelta(hours=23)), ("dir", now - dt.timedelta(days=9)), ("dir", now), ("link", None)]
    df = spark.createDataFrame(rows, "top string, mtime timestamp")
    go = lambda keep: sorted(r.top for r in policy.expire_entries(df, F.lit(now), keep).collect())
    assert go(1) == ["at", "link"] and go(0) == [] and go(-1) == [] and go(float("nan")) == []


def test_nearest_root(spark):
    paths = spark.createDataFrame([("/r/a/b/x",), ("/r/c",), ("/q/z",), ("/r/a",)], "path string")
    roots = spark.createDataFrame([("/r",), ("/r/a",)], "root string")
    got = {(r.path, r.root, r.rel) for r in policy.nearest_root(paths, roots).collect()}
    assert got == {("/r/a/b/x", "/r/a", "b/x"), ("/r/c", "/r", "c"), ("/r/a", "/r", "a")}


def test_feature_paths(spark):
    changed = spark.createDataFrame([("src/checkout/a.ts",), ("api/orders.ts",), ("components/CartRow",), ("components/x/CartRow",), ("lib/z",)], "path string")
    listed = spark.createDataFrame([("checkout", "src/checkout/"), ("checkout", "api/orders.ts"), ("cart", "components/Cart*"), ("any", "**/z")], "feature string, pattern string")
    got = {(r.path, r.feature) for r in policy.path_to_feature(changed, listed).collect()}
    assert got == {("src/checkout/a.ts", "checkout"), ("api/orders.ts", "checkout"), ("components/CartRow", "cart"), ("lib/z", "any")}
    assert [r.path for r in policy.unlisted_surface(changed, listed).collect()] == ["components/x/CartRow"]


@pytest.mark.parametrize("n,want", [(950, "950"), (12_900, "12k"), (3_999_999, "3M")])
def test_short_count(spark, n, want):
    assert spark.range(1).select(tx.short_count(F.lit(n)).alias("t")).first().t == want


def test_small_text(spark):
    one = spark.range(1).select(
        tx.duration_text(F.lit(11_100)).alias("d"), tx.duration_text(F.lit(720)).alias("m"), tx.flat(F.lit("## A *b*\n- `c`  d")).alias("f"),
        tx.clip(F.lit("abcdef"), 3).alias("c"), tx.short_id(F.lit("01234567-89ab-cdef-0123-456789abcdef")).alias("u"),
        tx.utf16_length(F.lit("a😀")).alias("l")).first()
    assert tuple(one) == ("3h05m", "12m", "A b c d", "abc...", "01234567…", 3)


def test_stream_verdicts_do_not_depend_on_file_order(spark, tmp_path):
    rows = [("s", 1, "mode", "main", "self", "", 3), ("s", 2, "agent_mode", "main", "self", "", 3), ("s", 3, "call", "main", "self", "", 2),
            ("s", 4, "mode", "main", "self", "", 1), ("s", 5, "call", "main", "self", "", 2), ("s", 6, "call", "main", "self", "", 1), (None, 7, "call", "main", "self", "", 9)]
    for row in reversed(rows):  # the last event comes in the first file
        spark.createDataFrame([row], "session string, seq long, kind string, agent string, scope string, parent string, rank int").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "actions"))
    got = live.stream_mode_verdicts(live.table_stream(spark, str(tmp_path / "actions"), files_per_batch=1)).collect()
    assert sorted((r["seq"], r["verdict"], r["by"]) for r in got) == [(3, "pass", None), (5, "deny", "user"), (6, "pass", None), (7, "deny", "user")]
