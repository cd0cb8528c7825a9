"""Quirks and golden results of the operators that SQL does not cover."""

import json
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from codestrata import cli, config
from codestrata.functions import code_filter, embed, language, outline, paths, pycode, relevance, symbols
from codestrata.operators import budget, chunking, churn, classify, graph, index, measure, memory, modules, projects, recall, search, timestamps
from codestrata.sources import files, transcripts
from codestrata.streaming import backfill


def lines(spark, entries):
    rows = [("s", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "session_id string, line_no int, line string")


def test_tool_shapes_and_context(spark):
    inp = {"file_path": "a.py", "content": "x = 1"}
    edit = {"file_path": "a.py", "old_string": "x", "new_string": "y"}
    got = transcripts.changes(lines(spark, [
        {"role": "user", "content": "please"},
        {"type": "tool_use", "name": "Write", "input": inp},
        "not json", "", '{"cut": ',
        {"tool": "Edit", "input": edit},
        {"role": "assistant", "content": [{"type": "text", "text": "now"}, {"type": "tool_use", "name": "Write", "input": inp}]},
        {"message": {"content": [{"type": "tool_use", "name": "Edit", "input": edit}]}},
        {"toolName": "Write", "toolInput": {"path": "b.py", "content": "z"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "Edit", "arguments": json.dumps(edit)}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Update File: c.py\n@@\n-old\n+new\n*** Add File: d.py\n+d\n*** Update File: e.py\n-gone\n"}},
        {"type": "tool_use", "name": "Read", "input": inp},
        {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py", "old_string": "x", "new_string": ""}},
        {"type": "tool_use", "name": "Write", "input": {"file_path": "a.py", "content": ""}},
    ])).orderBy("line_no", "file_path").collect()
    assert [(r.line_no, r.file_path, r.tool_type, r.new_code, r.old_code) for r in got] == [
        (1, "a.py", "Write", "x = 1", None), (5, "a.py", "Edit", "y", "x"), (6, "a.py", "Write", "x = 1", None), (7, "a.py", "Edit", "y", "x"),
        (8, "b.py", "Write", "z", None), (9, "a.py", "Edit", "y", "x"), (10, "c.py", "Edit", "new", "old"), (10, "d.py", "Write", "d", None),
    ]
    assert got[0].context == "please"


def test_context_across_stretches(spark):
    """Stretches of any length give the context that one window over the file gives."""
    rows = [("s" if i % 3 else "t", i * 1301 % 3001, f"m{i}" if i % 4 else None, "Edit" if i % 5 == 0 else None) for i in range(300)]
    e = spark.createDataFrame(rows, "file string, line_no int, text string, tool string")
    want = {(r.file, r.line_no): r.context for r in transcripts.with_context(e, stretch=10**6).collect()}
    for stretch in (1, 40, 333):
        assert {(r.file, r.line_no): r.context for r in transcripts.with_context(e, stretch=stretch).collect()} == want
    every = e.collect()
    for (f, n), context in list(want.items())[:60]:
        mine = sorted((r for r in every if r.file == f), key=lambda r: r.line_no)
        i = next(k for k, r in enumerate(mine) if r.line_no == n)
        after = []
        for r in mine[i + 1 : i + 6]:
            if r.tool:
                break
            after.append(r)
        assert context == "\n".join(r.text for r in [*mine[max(0, i - 5) : i], *after] if r.text)


def test_context_is_cut(spark):
    e = [{"role": "user", "content": "w" * 600}, {"role": "user", "content": "v" * 600}, {"tool": "Write", "input": {"file_path": "a", "content": "b"}}]
    (r,) = transcripts.changes(lines(spark, e)).collect()
    assert len(r.context) == 1003 and r.context.endswith("...")


def test_code_filter(spark):
    rows = [("a.py", None, True), ("README.md", None, False), ("x/docs/a.py", None, False), ("a.min.js", None, False), ("Makefile", None, True), (".gitignore", None, False), ("a.test.js", None, True),
        ("a.unknown", "def f(x):\n    return x + 1 and more", True), ("a.unknown", "tiny", False), ("a.unknown", "#!/bin/bash\necho hello world", True), ("a.unknown", None, False), ("a.txt", "def f(x): return 1 # code", False), ("A.PY", None, True)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, p string, c string")
    got = df.select("i", code_filter.is_code(F.col("p"), F.col("c")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [r[2] for r in rows]
    c = code_filter.FilterConfig.layered({"skip": [".py"]}, {"skip_paths": ["only/"]})
    c.add_code_extension("qq")
    assert c.skip == [".py"] and c.skip_paths == ["only/"] and ".qq" in c.code


def test_symbols_and_terms(spark):
    code = "import os\nfrom json import x\n@cache\ndef alpha(a):\n    pass\nclass Beta:\n    def alpha(self):\n        pass\n"
    r = spark.createDataFrame([(code, "dir/stem.py")], "c string, p string").select(symbols.code_symbols(F.col("c")).alias("s"), symbols.search_terms(F.col("c"), F.col("p")).alias("t")).first()
    assert r.s == ["Beta", "alpha"] and r.t == "json alpha Beta cache stem"


def test_language(spark):
    rows = [("Makefile", "all:"), (None, "#!/usr/bin/env python3\nprint(1)"), ("a.py", "import os"), ("a.zzz", "package main\n\nfunc main() {\n\tx := 1\n}\n"), ("q", ""), (None, None), ("b.txt", "# vim: ft=rust"), ("p.html", "<html><script>x</script></html>")]
    got = language.detect(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, c string"), "p", "c").orderBy("i").collect()
    assert [r.language for r in got] == ["makefile", "python", "python", "go", None, None, "rust", "html"]
    assert [r.method for r in got][:4] == ["special_file", "shebang", "extension", "content"] and got[7].embedded == ["javascript"]


def test_tiers(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (0, 3), (0, 10), (0, 11), (0, 20), (0, 21), (5, 5), (4, 5)], "a long, b long")
    assert [r[0] for r in df.select(churn.tier(F.col("a"), F.col("b"))).collect()] == ["gold", "gold", "silver", "silver", "bronze", "bronze", "red", "red", "silver"]
    assert [r[0] for r in df.select(churn.velocity(F.col("a"), F.col("b"))).collect()][7] == 10.0


def test_classification():
    f = "def f(a):\n    return a\n"
    g = "def g(b):\n    return b\n"
    assert classify.classify(None, f, ".py")[0] == "add"
    assert classify.classify(f, None, ".py")[0] == "delete"
    assert classify.classify(f, f + g, ".py")[0] == "add"
    assert classify.classify(f + g, f, ".py")[0] == "delete"
    kind, added, modified, deleted = classify.classify(f, f.replace("return a", "return a + 1"), ".py")
    assert kind == "modify" and [m[0] for m in modified] == ["f"] and not added and not deleted
    kind, added, modified, _ = classify.classify(f, f.replace("(a)", "(a, z)"), ".py")
    assert [m[0] for m in modified] == ["f"] and not added
    assert classify.classify(f, f + "# note\n", ".py")[0] == "refactor"
    js = "function f(a) {\n  return a;\n}\n"
    assert classify.classify(js, js.replace("return a", "return b"), ".js")[2] == []  # bodies are invisible to patterns
    assert classify.signature_hash(" Def  F( A ) ") == classify.signature_hash("def f( a )")


def test_chunks():
    code = '"""doc"""\nimport os\n\nX = 1\n\ndef f(a: int) -> int:\n    """d"""\n    return os.x(a)\n\nclass C(B):\n    def m(self):\n        return f(1)\n'
    got = chunking.chunk_code(code, ".py")
    assert Counter(c["kind"] for c in got) == Counter({"imports": 1, "constants": 1, "function": 2, "class": 1, "method": 1})
    f = next(c for c in got if c["name"] == "f")
    assert f["signature"] == "def f(a: int) -> int" and f["docstring"] == "d" and f["dependencies"] == ["a", "os", "x"]
    js = "export function a(x) {\n  if (x) { return '}'; }\n}\nconst b = (y) => {\n  return y;\n}\nclass D extends E {\n}\n"
    assert [(c["name"], c["start"], c["end"]) for c in chunking.chunk_code(js, ".js")] == [("a", 1, 3), ("b", 4, 6), ("D", 7, 8)]
    assert [c["name"] for c in chunking.chunk_code("a\nb\n\n\nc", ".txt")] == ["block_1", "block_2"]
    assert chunking.chunk_code(None, ".py") == [] and chunking.chunk_code("  \n", ".py") == []
    assert chunking.chunk_code("def (", ".py")[0]["kind"] == "block"
    long = "\n".join(f"x{i} = {i}" for i in range(1000))
    parts = chunking.chunk_code(long, ".txt", 100)
    assert "\n".join(p["code"] for p in parts) == long and parts[0]["name"].startswith("block_1_part1of")


def test_groups_equal_brute_force(spark):
    codes = ["def f(a):\n    return a + 1\n", "def f(b):\n    return b + 1\n", "class X:\n    pass\n", "def f(a):\n    return a + 2\n", "for i in x:\n    print(i)\n"]
    df = spark.createDataFrame([("q", str(i), "p/a.py", c, len(codes) - i) for i, c in enumerate(codes)], "q string, id string, path string, code string, s int")
    got = {r.id: r.group_no for r in chunking.group_snippets(df, "q", "id", "path", "code", F.lit("k"), F.col("s")).collect()}
    norm = [r[0] for r in df.orderBy("id").select(paths.normalise_shape(F.col("code"))).collect()]
    want, n = {}, 0
    for i in range(len(codes)):
        if str(i) in want:
            continue
        n += 1
        want[str(i)] = n
        for j in range(i + 1, len(codes)):
            if str(j) not in want and 0.7 * SequenceMatcher(None, norm[i], norm[j]).ratio() + 0.3 >= 0.7:
                want[str(j)] = n
    assert got == want


def test_call_graph_of_whole_index(spark, tmp_path):
    # every call edge of the files reaches the graph operators; against brute force
    from codestrata.plans import registry

    code = {"m.py": "import m\nimport n\ndef f():\n    m.g()\ndef g():\n    m.f()\n    n.h()\n", "n.py": "import n\ndef h():\n    n.k()\ndef k():\n    print(1)\ndef r():\n    n.r()\n"}
    spark.createDataFrame([(p, p, c, "2025-01-01", None) for p, c in code.items()], "id string, file_path string, new_code string, timestamp string, session_id string").write.parquet(f"{tmp_path}/code_memory.parquet")
    spark.createDataFrame([], "session_id string, client_zone string").write.parquet(f"{tmp_path}/sessions.parquet")
    q = {n: f(spark, str(tmp_path)).collect() for n, f in registry.queries().items() if n.startswith("call_graph_")}
    e = {(r.src, r.dst) for r in registry.queries()["index_calls"](spark, str(tmp_path)).collect()}
    assert e == {("m.f", "m.g"), ("m.g", "m.f"), ("m.g", "n.h"), ("n.h", "n.k"), ("n.k", "print"), ("n.r", "n.r")}
    c = set(e)
    while more := {(a, d) for a, b in c for x, d in e if b == x} - c:
        c |= more
    assert {(r.src, r.reached) for r in q["call_graph_closure"]} == set(Counter(a for a, _ in c).items())
    assert {r.node for r in q["call_graph_recursive"]} == {a for a, b in c if a == b} == {"m.f", "m.g", "n.r"}
    assert {(r.component, r.members) for r in q["call_graph_components"]} == {("m.g", 2), ("n.h", 1), ("n.k", 1), ("print", 1), ("n.r", 1)}
    assert {r.caller for r in q["call_graph_callers"]} == {a for a, b in c if b == "print"}  # called once as all others, the largest name
    assert {r.dst: r.path for r in q["call_graph_chains"]}["print"] == "m.f>m.g>n.h>n.k>print"
    assert q["call_graph_summary"][0].edges == len(e) and len(q["call_graph_degrees"]) == 6
    assert {r.node for r in q["call_graph_leaves"]} == {"print"} and not q["call_graph_entry_points"]
    assert {(r.src, r.dst) for r in q["call_graph_merge"]} >= e | {("m", "n")} and len(q["call_graph_dot"]) == len(e) + 1


def test_deep_scopes(spark):
    df = spark.createDataFrame([("a.py", i, i - 1 if i else None) for i in range(100)] + [("b.py", 0, None)], "file_path string, scope_id int, parent_id int")
    got = {(r.file_path, r.scope_id, r.ancestor_id, r.depth) for r in index.scope_chains(df).collect()}
    assert got == {("a.py", i, j, i - j) for i in range(100) for j in range(i + 1)} | {("b.py", 0, 0, 0)}


def test_groups_of_long_queries(spark):
    # every row of a query has a group, as by brute force over all pairs
    import random

    r = random.Random(3)
    words = ["load", "keep", "rope", "badger", "ledger", "yield", "post", "fold"]
    codes = ["\n".join(f"{r.choice(words)} = {r.choice(words)}({r.choice(words)})" for _ in range(r.randint(1, 4))) for _ in range(150)] + ["", ""]
    df = spark.createDataFrame([("q", i, f"p/{'ab'[i % 2]}.py", c, "xy"[i % 3 == 0], -i) for i, c in enumerate(codes)], "q string, id int, path string, code string, kind string, s int")
    got = {x.id: (x.group_no, x.size) for x in chunking.group_snippets(df, "q", "id", "path", "code", F.col("kind"), F.col("s")).collect()}
    rows = df.orderBy("id").select("path", "kind", paths.normalise_shape(F.col("code")).alias("norm")).collect()
    want, n = {}, 0
    for i in range(len(rows)):
        if i not in want:
            n += 1
            want[i] = n
            for j in range(i + 1, len(rows)):
                if j not in want and chunking.similarity(rows[i], rows[j]) >= 0.7:
                    want[j] = n
    size = Counter(want.values())
    assert got == {i: (g, size[g]) for i, g in want.items()} and 20 < n < 150 and max(size.values()) > 1
    for _ in range(50):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert chunking.common_length(a, b) == t[len(a)][len(b)]


def test_budget(spark):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate([100, 300, 50, 400, 60])], "g string, i int, t int")
    got = budget.skip_fold(df, "g", ["i"], F.col("t"), 450).orderBy("n").collect()
    assert [(r.n, r.tokens) for r in got] == [(1, 100), (2, 300), (3, 50)]
    code = "\n".join("x" * 20 for _ in range(100))
    r = spark.createDataFrame([(code,)], "c string").select(budget.truncate_lines(F.col("c"), F.lit(60)).alias("t"), budget.truncate_lines(F.col("c"), F.lit(10)).alias("n"), budget.truncate_lines(F.col("c"), F.lit(10**6)).alias("w")).first()
    kept = r.t.removesuffix("\n# ... (truncated)")
    est = lambda s: int(len(s) / 4 * 1.1) + 1 + 4
    assert est(kept) <= 60 < est(kept + "\n" + "x" * 20) and r.n is None and r.w == code


def test_budget_truncating(spark):
    import random

    r = random.Random(5)
    est = lambda t: (int(len(t) / 4 * 1.1) + 1 if t else 0) + 4
    make = lambda lines, width: "\n".join("x" * r.randint(0, width) for _ in range(lines))
    codes = {"a": [make(200, 60), make(5, 40), "y" * 3000, "", "\n" + "z" * 9000] + [make(r.randint(1, 30), 80) for _ in range(60)], "b": ["w" * 8000] * 1200 + ["k = 1"] * 40, "c": ["v" * 4000, make(300, 20)]}
    want = set()
    for g, l in codes.items():
        left = 1900
        for n, code in enumerate(l, 1):
            if left < 50:
                break
            text = code
            if est(code) > left:
                parts = code.split("\n")
                fits = [t for t in ("\n".join(parts[:i]) for i in range(1, len(parts) + 1)) if est(t) <= min(left, 500)]
                if not fits or not fits[-1]:
                    continue
                text = fits[-1] + "\n# ... (truncated)"
            left -= est(text)
            want.add((g, n, est(text), text))
    df = spark.createDataFrame([(g, i, c) for g, l in codes.items() for i, c in enumerate(l)], "g string, i int, c string")
    got = {tuple(x) for x in budget.allocate_truncating(df, "g", ["i"], "c").collect()}
    assert got == want and any(n > 1200 for _, n, _, _ in want) and any(t.endswith("(truncated)") for *_, t in want)


def test_budget_of_long_groups(spark):
    # over 1000 rows that do not fit, then small ones; sizes in any mixture against the plain loop
    sizes = {"big": [600] * 1500 + [40, 7], "mixed": [(i * 7919) % 530 for i in range(3000)] + [1, 2, 0, 3], "tail": [490] * 3 + [431] * 1200 + [5] * 3}
    df = spark.createDataFrame([(g, i, t) for g, l in sizes.items() for i, t in enumerate(l)], "g string, i int, t int")
    want = set()
    for g, l in sizes.items():
        left = 1900
        for n, t in enumerate(l, 1):
            if t <= min(left, 500):
                left -= t
                want.add((g, n, t))
    assert {tuple(r) for r in budget.skip_fold(df, "g", ["i"], F.col("t"), 1900, 500).collect()} == want
    assert ("big", 1501, 40) in want and ("tail", 1204, 5) in want


def test_injections_of_a_long_session(spark, tmp_path):
    from codestrata.plans import code_queries

    rows = [(f"{i:05d}", "s", "/srv/work/kestrel-relay/engine/posting_loop.py", "x" * 2000, None) for i in range(1100)] + [("99999", "s", "/srv/work/kestrel-relay/engine/posting_loop.py", "last = 1", None)]
    spark.createDataFrame(rows, "id string, session_id string, file_path string, new_code string, context string").write.parquet(f"{tmp_path}/code_memory.parquet")
    got = code_queries.injections(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].snippets == 1 and "last = 1" in got[0].text


def test_relevance(spark):
    df = spark.createDataFrame([("a/b/c.py", "a/b/c.py"), ("a/b/d.py", "a/b/c.py"), ("a/x/d.py", "a/b/c.py"), ("a/q/r/s/d.py", "a/b/c.py"), (None, "a"), ("z.py", "y.py")], "p string, c string")
    got = [r[0] for r in df.select(F.round(relevance.proximity(F.col("p"), F.col("c")), 6)).collect()]
    assert got == [1.0, 0.8, 0.6, 0.4, 0.5, 0.8]
    t = F.lit("2024-01-08 00:00:00+00:00").cast("timestamp")
    s = spark.createDataFrame([("2024-01-01 00:00:00+00:00",), ("2023-01-01 00:00:00+00:00",), (None,)], "t string").select(F.round(relevance.recency(F.col("t").cast("timestamp"), t), 6))
    assert [r[0] for r in s.collect()] == [0.5, 0.0, 0.5]


def test_search_rules(spark):
    assert search.escape_query("a(b)*c") == "a b c" and search.escape_query("()") == "*"
    assert search.query_terms("foo bar") == (["bar", "foo"], True)
    assert search.query_terms("foo/bar, x") == (["bar", "foo", "x"], False)
    assert search.query_terms("  ") == ([], True)
    df = spark.createDataFrame([(-1.0,), (-9.0,), (0.5,), (None,)], "r double")
    assert [round(r[0], 2) for r in df.select(search.normalise_rank(F.col("r"))).collect()] == [0.5, 0.1, 0.5, 0.0]
    assert [round(r[0], 2) for r in df.select(search.normalise_rank(F.col("r"), "monotone")).collect()] == [0.5, 0.9, 0.5, 0.0]
    m = spark.createDataFrame([("1", "p", "alpha beta", None, [1.0, 0.0]), ("2", "p", "alpha", None, [0.0, 1.0]), ("3", "p", None, None, None)], "id string, file_path string, new_code string, context string, embedding array<float>")
    assert [r.id for r in search.lexical(m, "alpha beta", 5).collect()] == ["1"] and search.lexical(m, "", 5).count() == 0
    assert [(r.id, r.score) for r in search.semantic(m, [2.0, 0.0], 5).collect()] == [("1", 1.0), ("2", 0.0)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5), (6, 7)], "src int, dst int")
    c = {tuple(r) for r in graph.closure(e).collect()}
    assert (1, 1) in c and (1, 5) in c and (5, 5) in c and (4, 4) not in c and (6, 7) in c
    assert {r.node for r in graph.recursive(e).collect()} == {1, 2, 3, 5}
    comp = {r.node: r.component for r in graph.components(e).collect()}
    assert comp == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    p = {r.dst: r.path for r in graph.chains(e, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert p == {1: [1], 2: [1, 2], 3: [1, 2, 3]}
    assert {r.node for r in graph.entry_points(e).collect()} == {6} and {r.node for r in graph.leaves(e).collect()} == {7}
    assert graph.components(e.where("false")).count() == 0


def test_reach_counts_equal_the_closure(spark):
    import random

    r = random.Random(5)
    for n, m in ((40, 70), (300, 240), (60, 200)):
        rows = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(n, n), (n + 1, n + 2), (n + 3, 0)} | {(a, a + 1) for a in range(n + 10, n + 40)})
        e = spark.createDataFrame(rows, "src long, dst long")
        want = {x.src: x.n for x in graph.closure(e).groupBy("src").agg(F.count("*").alias("n")).collect()}
        # with one word of bits, with all bits and over the pairs of components
        for args in ({"bits_bytes": 64}, {}, {"packed_edges": 0}):
            assert {x.src: x.reached for x in graph.reach_counts(e, **args).collect()} == want
    assert graph.reach_counts(e.where("false")).count() == 0
    names = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {x.src: x.reached for x in graph.reach_counts(names).collect()} == {"a": 3, "b": 3}


def test_closure_counts_write_no_pairs(spark, tmp_path, monkeypatch):
    # most nodes reach most nodes: their pairs were written, far more rows than there are edges
    import random

    from codestrata.plans import graph_queries

    r, n, kept = random.Random(7), 60, []
    spark.createDataFrame([(i, r.randrange(n), 50.0, 1) for i in range(n) for _ in range(3)], "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    want = {x.src: x.n for x in graph.closure(graph_queries._e(spark, str(tmp_path))).groupBy("src").agg(F.count("*").alias("n")).collect()}
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := cut(df), kept.append(out.count()))[0])
    got = graph_queries.graph_closure(spark, str(tmp_path)).collect()
    assert {x.src: x.reached for x in got} == want and sum(want.values()) > 2000 > 3 * n >= max(kept)


SOURCE = '''import os
from lib.util import helper as h, other

LIMIT = 10
name = "x"

class Base:
    """A base."""
    def run(self, n: int) -> int:
        total = LIMIT + n
        total = h(total)
        return total

    async def later(self):
        return self.run(1)

def free(a, *rest):
    b = Base()
    c = b
    return b.run(a), os.getcwd()
'''


def test_index(spark):
    f = spark.createDataFrame([("pkg/mod.py", SOURCE), ("lib/util.py", "def helper(x):\n    return helper(x)\n"), ("bad.py", "def ("), ("none.py", None)], "file_path string, code string")
    parsed = index.facts(f)
    s, r, c = (index.facts_table(parsed, w) for w in ("symbols", "references", "scopes"))
    q = {x.qualified_name: x for x in s.where("file_path = 'pkg/mod.py'").collect()}
    assert q["pkg.mod.Base.run"].kind == "method" and q["pkg.mod.Base.run"].type_string == "int" and q["pkg.mod.Base.later"].is_async
    assert q["pkg.mod.free.a"].kind == "parameter" and q["pkg.mod.h"].imported_from == "lib.util" and q["pkg.mod.LIMIT"].type_string == "int"
    d = {(x.name, x.start_line): x for x in index.definitions(r, s, c).where("file_path = 'pkg/mod.py'").collect()}
    assert d["h", 11].qualified_name == "lib.util.helper" and d["h", 11].def_file == "lib/util.py" and d["h", 11].status == "resolved"
    assert d["os.getcwd", 20].status == "external" and d["LIMIT", 10].qualified_name == "pkg.mod.LIMIT"
    n = {x.qualified_name: x for x in index.references_to(s, r).collect()}
    assert n["lib.util.helper"].calls == 1 and n["pkg.mod.Base"].calls == 1
    assert {x.qualified_name for x in index.unused(s, r).collect()} >= {"pkg.mod.name", "pkg.mod.free"}
    t = {x.qualified_name: (x.type, x.source) for x in index.infer_types(s).collect()}
    assert t["pkg.mod.free.b"] == ("Base", "declared") and t["pkg.mod.free.c"] == ("Base", "propagated")
    pos = spark.createDataFrame([(1, "pkg/mod.py", 11, 16), (2, "pkg/mod.py", 10, 8)], "pos_id int, file_path string, line int, col int")
    e = {x.pos_id: (x.what, x.name) for x in index.entity_at(pos, s, r).collect()}
    assert e == {1: ("reference", "h"), 2: ("symbol", "total")}
    assert {x.pos_id: x.kind for x in index.scope_at(pos, c).collect()} == {1: "function", 2: "function"}
    edges = {(x.src, x.dst) for x in index.import_edges(s).collect()}
    assert edges == {("pkg.mod", "os"), ("pkg.mod", "lib.util")}
    assert {x.file_path for x in index.affected_files(f.where("file_path = 'lib/util.py'"), index.import_edges(s), f).collect()} == {"pkg/mod.py"}
    h = {x.qualified_name: x for x in index.hover(s).collect()}
    assert h["pkg.mod.Base.run"].title.startswith("def run(self") and h["pkg.mod.Base.run"].title.endswith("-> int") and "A base." in h["pkg.mod.Base"].markdown
    assert h["pkg.mod.Base.later"].title == "async def later(self)" and h["pkg.mod.h"].title == "from lib.util import helper as h" and h["pkg.mod.free.a"].title == "(parameter) a"
    rows = [tuple(x) for x in index.reference_rows(s, r).where("qualified_name = 'lib.util.helper'").orderBy("position").select("file_path", "start_line", "use").collect()]
    assert rows == [("lib/util.py", 1, "write"), ("lib/util.py", 2, "call")]
    at = spark.createDataFrame([(1, "lib/util.py", 2, 11), (2, "lib/util.py", 1, 11)], "pos_id int, file_path string, line int, col int")
    assert {x.pos_id: x.title for x in index.signature_help(at, s, r).collect()} == {1: "def helper(x)"}
    assert {x.pos_id: x.title for x in index.hover_at(at, s, r).collect()} == {1: "def helper(x)", 2: "(parameter) x"}
    assert [(x.start_line, x.use) for x in index.references_at(at.where("pos_id = 1"), s, r).orderBy("position").collect()] == [(1, "write"), (2, "call")]
    files_ = {x.file_path: (x.lines, x.has_errors, x.is_complete) for x in index.completeness(index.facts_table(parsed, "files")).collect()}
    assert files_["bad.py"] == (1, True, False) and files_["none.py"] == (1, False, True) and len(files_) == 4
    assert index.remove_files(parsed, f.where("file_path = 'lib/util.py'")).where("file_path = 'lib/util.py'").count() == 0
    groups = {(x.file_path, x.imported_from): x.names for x in index.imports_by_module(s).collect()}
    assert groups["pkg/mod.py", "lib.util"] == ["helper", "other"] and groups["pkg/mod.py", "os"] == ["os"]


def test_index_of_sources_in_braces(spark):
    code = {
        "web/app.ts": "import {readFile as rf} from './lib/io.js';\nexport async function load(url: string, opts = {a: 1}): Promise<string> {\n  const res = await fetch(url);\n  return rf(res, /[{\"]/);\n}\nexport default class Store extends Base {\n  size = 0;\n  add(item: Item) { load(item); return this; }\n}\nlet n = 1;\nn = n + 1;\n",
        "web/lib/io.js": "export function readFile(p) { return p; }\n",
        "calc.rs": "use std::{fmt, io::{self, Read as R}};\npub struct Calc<'a> { v: i32 }\nimpl<'a> fmt::Display for Calc<'a> { fn fmt(&self, f: &mut Fm) -> fmt::Result { write!(f, \"{}\", '{') } }\npub async fn add(a: i32, b: i32) -> i32 { mul(a, b) }\nfn mul(a: i32, b: i32) -> i32 { a * b }\n",
        "m.go": 'package m\nimport (\n  "fmt"\n)\ntype Calc struct {\n  v int\n}\nfunc (c *Calc) Add(a, b int) (int, error) {\n  r := mul(a, b)\n  fmt.Println(r)\n  return r, nil\n}\nfunc mul(a, b int) int { return a * b }\n',
        "p.c": "#include <stdio.h>\nstruct P { int x; };\nstatic int add(int a, const char *b) { int r = mul(a, 2); return r; }\nint mul(int a, int b);\n",
    }
    parsed = index.facts(spark.createDataFrame(list(code.items()), "file_path string, code string"))
    s, r, sc = (index.facts_table(parsed, w) for w in ("symbols", "references", "scopes"))
    q = {x.qualified_name: x for x in s.collect()}
    assert (q["web.app.load"].kind, q["web.app.load"].is_async, q["web.app.load"].is_exported, q["web.app.load"].type_string, q["web.app.load"].end_line) == ("function", True, True, "Promise<string>", 5)
    assert [tuple(p) for p in q["web.app.load"].parameters] == [("url", "string"), ("opts", None)] and q["web.app.Store"].base_classes == ["Base"] and q["web.app.Store.add"].kind == "method" and q["web.app.Store.size"].kind == "property"
    assert (q["calc.Calc.fmt"].kind, q["calc.Calc"].base_classes, q["calc.R"].imported_from, q["calc.R"].import_name) == ("method", ["fmt::Display"], "std.io", "Read") and not q["calc.mul"].is_public and q["calc.Calc.v"].type_string == "i32"
    assert (q["m.Calc.Add"].type_string, [tuple(p) for p in q["m.Calc.Add"].parameters], q["m.Calc.Add.r"].kind, q["m.fmt"].kind) == ("(int, error)", [("a", "int"), ("b", "int")], "variable", "import")
    assert (q["p.add"].kind, q["p.add"].is_public, q["p.P"].kind, q["p.mul"].kind, q["p.stdio"].imported_from) == ("function", False, "class", "function", "stdio.h")
    calls = {(x.caller, x.callee) for x in index.facts_table(parsed, "calls").collect()}
    assert calls >= {("web.app.load", "fetch"), ("web.app.load", "web.app.rf"), ("web.app.Store.add", "web.app.load"), ("calc.add", "calc.mul"), ("calc.Calc.fmt", "write!"), ("m.Calc.Add", "m.mul"), ("m.Calc.Add", "fmt.Println"), ("p.add", "p.mul")}
    use = {(x.name, x.start_line): (x.is_write, x.is_call, x.resolved) for x in r.where("file_path = 'web/app.ts'").collect()}
    assert use["rf", 4] == (False, True, "web.app.rf") and use["n", 11][2] == "web.app.n"
    assert ("web.app", "web.lib.io") in {(x.src, x.dst) for x in index.import_edges(s).collect()}
    d = {(x.file_path, x.name): x.qualified_name for x in index.definitions(r, s, sc).collect()}
    assert d["m.go", "mul"] == "m.mul"


def test_outcomes_of_a_change():
    """The four outcomes by the counts of added, modified and deleted functions, in their order."""
    a, b, c, m = ("def a():\n    return 1\n", "def b():\n    return 2\n", "def c():\n    return 3\n", "def m(x):\n    return 4\n")
    kind = lambda old, new: classify.classify(old, new, ".py")[0]
    assert kind(None, a) == "add" and kind("", a) == "add"
    assert kind(a, b) == "add"  # one added, one deleted
    assert kind(a + b, c) == "delete"  # two deleted, one added
    assert kind(a + b + m, m.replace("4", "5")) == "delete"  # two deleted, one modified
    assert kind(a + m, c + m.replace("4", "5")) == "modify"
    assert kind(a, a + "# a note\n") == "refactor" and kind("x = 1\n", "import os\nfor q in range(7):\n    print(q)\n") == "modify"
    # a name that stays under its old signature counts as modified with another one
    _, added, modified, deleted = classify.classify(m, m + m.replace("(x)", "(x, y)"), ".py")
    assert (added, [n for n, _ in modified], deleted) == ([], ["m"], [])


def test_blocks_in_braces():
    js = (
        "// function no() {\nimport x from 'y'\nexport default async function go(a, b = {x: 1}) {\n  const s = '}' + `a ${b} }`;\n  if (a) { return 1; }\n  /* } */\n}\n"
        "const add = async (x, y) => {\n  return x + '}';\n};\nclass A extends B { m() { return 1 } }\nfoo(function bar() { return 1 }, 2)\nfunction open() {\n  if (1) {\n"
    )
    assert [(c["kind"], c["name"], c["start"], c["end"]) for c in outline.blocks(js, ".js")] == [("function", "go", 3, 7), ("function", "add", 8, 10), ("class", "A", 11, 11), ("function", "bar", 12, 12), ("function", "open", 13, 15)]
    assert outline.blocks(js, ".ts")[1]["signature"] == "const add = async (x, y) =>"
    rs = "impl<'a> Foo<'a> for Bar<'a> {\n  pub fn f(&self) -> char { '{' }\n}\n#[x]\npub struct S { a: i32 }\nfn g<T>() where T: X {\n match x { Some(y) => {1}, _ => {2} }\n}\n"
    assert [(c["kind"], c["name"], c["start"], c["end"]) for c in outline.blocks(rs, ".rs")] == [("class", "Bar", 1, 3), ("function", "f", 2, 2), ("class", "S", 5, 5), ("function", "g", 6, 8)]
    go = "package x\n\nfunc (r *T) Name(a int) (int, error) {\n\tif a := f(); a > 1 {\n\t}\n\treturn `}`\n}\ntype S struct {\n a int\n}\nfunc Plain() {}\n"
    assert [(c["kind"], c["name"], c["start"], c["end"], c["signature"]) for c in outline.blocks(go, ".go")] == [("function", "Name", 3, 7, "func (r *T) Name(a int) (int, error)"), ("class", "S", 8, 10, None), ("function", "Plain", 11, 11, "func Plain()")]
    c = "#include <a>\nstatic int *f(int a, char c) {\n  if (a) { return g(a); } else if (c == '{') {}\n  for (;;) {}\n}\nstruct P {\n int x;\n};\nint A::b() const { return 1; }\nint xs[] = { 1, 2 };\n"
    assert [(x["kind"], x["name"], x["start"], x["end"]) for x in outline.blocks(c, ".c")] == [("function", "f", 2, 5), ("class", "P", 6, 8), ("function", "A::b", 9, 9)]
    long = "x" * 5000
    assert [x["name"] for x in outline.outline(f"export function f(a = '{long}') {{\n}}\n", ".js")] == ["f"] and outline.line_functions(f"def f(a='{long}'):", ".py")[0]["name"] == "f"


def test_python_chunks():
    code = "import a\nfrom b import (\n  c,\n)\nA = [\n 1,\n]\ntry:\n    import z\nexcept ImportError:\n    z = None\nclass K:\n    def m(self, q: int) -> str:\n        def inner(): pass\n        return self.x(q)\nB: int = 2\n"
    got = pycode.chunks(code)
    assert [(c["kind"], c["name"], c["start"], c["end"], c["parent"]) for c in got] == [
        ("imports", "imports", 1, 9, None), ("class", "K", 12, 15, None), ("function", "m", 13, 15, None), ("method", "m", 13, 15, "K"), ("function", "inner", 14, 14, None), ("constants", "constants", 5, 16, None)
    ]
    assert got[0]["code"] == "import a\nfrom b import (\n  c,\n)\n    import z" and got[-1]["code"] == "A = [\n 1,\n]\nB: int = 2"
    assert got[2]["dependencies"] == ["q", "x"] and got[2]["signature"] == "def m(self, q: int) -> str"


def test_outlines():
    rs = "use a::b::{c, d};\npub struct P { x: i32 }\nimpl P {\n    pub async fn go(&self) {}\n}\nfn own() {}\nenum E { A }\ntrait T {}\n"
    got = [(x["kind"], x["name"], x["is_public"]) for x in outline.outline(rs, ".rs")]
    assert got == [("import", "a::b", False), ("class", "P", True), ("impl", "P", False), ("function", "go", True), ("function", "own", False), ("enum", "E", False), ("interface", "T", False)]
    go = 'package m\nimport (\n\t"fmt"\n)\ntype S struct {\n}\nfunc (s *S) Get() {}\nfunc own() {}\n'
    assert [(x["kind"], x["name"], x["is_public"]) for x in outline.outline(go, ".go")] == [("import", "fmt", False), ("class", "S", True), ("method", "Get", True), ("function", "own", False)]
    ts = "import { a } from './x';\nexport interface I { }\nexport const f = async (x: number) => x;\ntype T = string;\n"
    assert [(x["kind"], x["name"]) for x in outline.outline(ts, ".ts")] == [("import", "./x"), ("interface", "I"), ("function", "f"), ("type", "T")]
    c = "#include <stdio.h>\nstatic int f(int a) {\n}\nstruct S {\n};\nint main(void) {\n  if (x) {}\n}\n"
    assert [(x["kind"], x["name"], x["is_public"]) for x in outline.outline(c, ".c")] == [("import", "stdio.h", True), ("function", "f", False), ("class", "S", True), ("function", "main", True)]
    assert pycode.chunks("def (") is None


def test_memory_changes(spark):
    m = spark.createDataFrame([("1", "p", "t1", [1.0]), ("2", "p", "t2", None)], "id string, file_path string, timestamp string, embedding array<float>")
    new = spark.createDataFrame([("8", "p", "t1"), ("9", "q", "t1"), ("7", "q", "t1")], "id string, file_path string, timestamp string")
    assert [r.id for r in memory.store(m.select("file_path", "timestamp"), new).collect()] == ["7"]
    v = spark.createDataFrame([("2", [5.0])], "id string, embedding array<float>")
    assert {r.id: r.embedding for r in memory.update_embedding(m, v).collect()} == {"1": [1.0], "2": [5.0]}
    assert [r.id for r in memory.delete(m, v).collect()] == ["1"]
    assert memory.coverage(m.limit(0)).first().coverage == 0.0
    big = spark.range(1000).selectExpr("cast(id as string) as id", "id as k").repartition(7)
    b = {r.k: r.batch for r in memory.number_batches(big, [F.col("k")], 100).collect()}
    assert b == {i: i // 100 + 1 for i in range(1000)}


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.jsonl").write_text('{"a": 1}\n\n{"b": 2}\n')
    (tmp_path / "b.txt").write_text("no")
    got = transcripts.read_lines(spark, str(tmp_path)).where("line <> ''").orderBy("pos").collect()
    assert [(r.pos, r.line) for r in got] == [(0, '{"a": 1}'), (2, '{"b": 2}')]
    (tmp_path / "m.py").write_text("x = 1\n")
    (tmp_path / "sub/skip_me.py").write_text("y = 1\n")
    assert [r.code for r in files.read_sources(spark, str(tmp_path), "*.py", ["skip_"]).collect()] == ["x = 1\n"]


def test_embedder_and_codec(spark):
    v = embed.hash_embed("a b a")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-6 and not any(embed.hash_embed(""))
    assert embed.unpack(embed.pack([1.0, 2.5])) == [1.0, 2.5]

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t))] for t in texts]

        return model

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, t string").coalesce(1)
    got = {r.i: (r.e.vector, r.e.error) for r in df.select("i", embed.embed(F.col("t"), load).alias("e")).collect()}
    assert got == {1: ([2.0], None), 2: (None, "bad text"), 3: ([0.0], None)}


def test_retry_and_rate(spark):
    now = F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")
    q = spark.createDataFrame([("a", 2, None, False)], "id string, attempts int, next_try timestamp, permanent boolean")
    out = {r.id: r for r in backfill.record_failures(q, spark.createDataFrame([("a",), ("b",)], "id string"), now).collect()}
    assert out["a"].permanent and out["a"].attempts == 3 and not out["b"].permanent
    assert [r[0] <= 90 for r in spark.range(20).select(backfill.backoff(F.col("id"), F.col("id").cast("string"))).collect()] == [True] * 20
    rows = [("k", i, t) for i, t in enumerate([0, 0, 0, 1, 10, 10, 10])]
    df = spark.createDataFrame(rows, "k string, i int, t long").withColumn("t", F.timestamp_seconds("t"))
    got = [r.accepted for r in backfill.token_bucket(df, "k", "t", "i", 2, 1.0).orderBy("i").collect()]
    assert got == [True, True, False, True, True, True, False]


def test_modules(spark):
    f = spark.createDataFrame([
        ("a.py", "from b import f, g as h, gone\nfrom os import path\nimport sys\n"), ("b.py", "from c import *\nfrom d import g\n"), ("c.py", "from e import *\nx = 1\n_p = 2\n"),
        ("d.py", "from b import g\n"), ("e.py", "__all__ = ['f']\ndef f():\n    pass\ndef other():\n    pass\n"),
    ], "file_path string, code string")
    p = index.facts(f)
    s, a = index.facts_table(p, "symbols"), index.facts_table(p, "all_names")
    names = {(r.module, r.name) for r in modules.exported_names(s, a).collect()}
    assert ("e", "f") in names and ("e", "other") not in names and ("c", "_p") not in names and ("d", "g") in names
    stars = {(r.module, r.name) for r in modules.star_names(s, a).collect()}
    assert stars == {("c", "f"), ("b", "x"), ("b", "f")}
    got = {(r.module, r.name): (r.origin, r.target, r.status) for r in modules.resolve(s, a).collect()}
    assert got["a", "f"] == ("e", "f", "resolved") and got["a", "path"][2] == "external" and got["a", "h"][2] == "unresolved" and got["a", "gone"][2] == "unresolved"


def test_recall(spark):
    code = "def load_thing(x):\n    return x + {}\n"
    m = spark.createDataFrame([(str(i), "src/a.py", code.format(i), None, "2024-01-05T00:00:00Z") for i in range(6)] + [("z", "other/b.py", "class Unrelated:\n    pass\n", None, "junk")], "id string, file_path string, new_code string, context string, timestamp string")
    p = spark.createDataFrame([(1, "src/a.py", "def load_thing(y):\n    return y\n", "Edit"), (2, "q.py", "zzz", "Write")], "change_id long, file_path string, new_code string, tool_type string")
    m = timestamps.normalise(m, "timestamp").withColumnRenamed("utc_us", "at_us")
    r = recall.recall(m, p, F.lit("2024-01-06 00:00:00+00:00").cast("timestamp"), F.lit("src"))
    got = {x.query_id: x for x in r.collect()}
    assert set(got) == {1} and got[1].groups == 1 and "Similar occurrences: 6" in got[1].text
    assert recall.hook_text(r, p).first().text.startswith('<memory context="You are editing a.py">')


def test_config_and_cli(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("search_limit: 9\nmax_tokens: 77\nbad: 1\n")
    c = config.load(str(tmp_path / "c.yaml"), {"CODESTRATA_MAX_TOKENS": "88", "CODESTRATA_BATCH_SIZE": "x"})
    assert (c.search_limit, c.max_tokens, c.batch_size) == (9, 88, 32)
    from tests.conftest import SF

    for argv in (["stats"], ["recent", "-l", "3"], ["search", "signal parser", "-p", "/"], ["hotspots", "--as-of", "2025-06-15T12:00:00Z"], ["files", "--tier", "gold", "--as-of", "2025-06-15T12:00:00Z"], ["churn", "nofile"], ["churn", "nofile", "-H"], ["churn", "nofile", "-f"]):
        assert cli.main(["--store", SF, "--json", *argv]) == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t/s.jsonl").write_text(json.dumps({"tool": "Write", "input": {"file_path": "n.py", "content": "x = 1\n"}, "timestamp": "2024-01-01T00:00:00Z"}) + "\n")
    assert cli.main(["--store", SF, "ingest", str(tmp_path / "t"), str(tmp_path / "new")]) == 0
    (row,) = spark.read.parquet(str(tmp_path / "new")).collect()
    assert row.file_path == "n.py" and len(row.embedding) == 384


def test_notifications_keep_their_distance(spark):
    rows = [("e", i, t) for i, t in enumerate([0, 30, 59, 60, 61, 130])]
    df = spark.createDataFrame(rows, "k string, i int, t long").withColumn("t", F.timestamp_seconds("t"))
    assert [r.accepted for r in backfill.notify(df, "k", "t", "i").orderBy("i").collect()] == [True, False, False, True, False, True]


def test_written_and_cut(spark):
    from codestrata.session import cut, release, written

    df = spark.range(10).withColumn("x", F.array("id"))
    w = written(df, "t")
    assert sorted(r.id for r in w.collect()) == list(range(10)) and w.columns == df.columns
    assert cut(df).where("id > 4").count() == 5
    assert release(spark) >= 1 and release(spark) == 0


def test_cycles_and_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), ("d", "s")], "src string, dst string")
    got = {tuple(r.path) for r in graph.cycles(e).collect()}
    assert got == {("c", "b", "c"), ("y", "x", "y"), ("s", "s")} and graph.has_cycles(e)
    line = spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.chains(line, start, None).agg(F.max("nodes")).first()[0] == 15 and graph.chains(line, start).count() == 10
    assert graph.cycles(line).count() == 0 and not graph.has_cycles(line)


def test_batch_hybrid_and_ragged_vectors(spark):
    m = spark.createDataFrame([("a", "p/a.py", "signal parser", None, [1.0, 0.0]), ("b", "p/b.py", "other text", None, [0.6, 0.8]), ("c", "p/c.py", "signal only", None, [1.0]), ("d", "p/d.py", "none", None, None), ("e", "p/e.py", "none", None, [float("nan"), 1.0])], "id string, file_path string, new_code string, context string, embedding array<float>")
    q = spark.createDataFrame([(1, "signal", [1.0, 0.0]), (2, "zzz", [0.0, 2.0, 0.0]), (3, "other", None)], "query_id int, query string, vector array<float>")
    near = {(r.query_id, r.id): r.score for r in search.batch_semantic(m, q.where("vector is not null"), 5).collect()}
    for i, v in ((1, [1.0, 0.0]), (2, [0.0, 2.0, 0.0])):  # as the cosine of a single pair has it, over the shorter length
        for r in search.semantic(m, v, 10).collect():
            assert near[i, r.id] == r.score
    got = {(r.query_id, r.id): r.relevance for r in search.batch_hybrid(m, q, 3).collect()}
    assert {k for k in got if k[0] == 3} == {(3, "b")} and (1, "a") in got and got[1, "c"] >= 0.6 and (2, "b") in got and (2, "a") not in got


def test_projects_and_limits(spark):
    f = spark.createDataFrame([("1", "/w/app/src/a.py"), ("2", "/w/app/go.mod"), ("3", "/w/app/lib/package.json"), ("4", "\\w\\app\\lib\\x.js"), ("5", "loose.py"), ("6", "/w/git/.git/config")], "id string, file_path string")
    r = projects.roots(f)
    assert {x.root for x in r.collect()} == {"/w/app", "/w/app/lib", "/w/git"}
    assert {x.id: x.root for x in projects.detect(f, r).collect()} == {"1": "/w/app", "2": "/w/app", "3": "/w/app/lib", "4": "/w/app/lib", "6": "/w/git"}
    s = measure.parser_runs(spark, (".py", ".rs", ".c"), 3, 2, 1)
    assert {x.ext for x in s.where("symbols >= 5").collect()} == {".py", ".rs", ".c"}
    load = embed.first_of([lambda: 1 / 0, lambda: lambda texts: [[1.0] for _ in texts]])
    assert load()(["x"]) == [[1.0]] and len(embed.first_of([lambda: 1 / 0])()(["x"])[0]) == embed.DIM
    left, n = memory.clear(f)
    assert left.count() == 0 and n.first().cleared == 6


def test_search_of_many_queries_equals_the_batch(spark):
    import random

    r, words = random.Random(3), [f"w{i}" for i in range(12)]
    rows = [(f"{i:04d}", "p.py", " ".join(r.choices(words, k=r.randrange(7))), None) for i in range(300)] + [(f"t{i:03d}", "p.py", "w0 w1 rare", None) for i in range(40)]
    m = spark.createDataFrame(r.sample(rows, len(rows)), "id string, file_path string, new_code string, context string").repartition(3)
    q = [(i, " ".join(r.choices([*words, "absent", "rare"], k=r.randrange(1, 5)))) for i in range(30)] + [(90, "w1 W0"), (91, "w0 w1 w0"), (92, ""), (93, "absent"), (94, "py"), (95, "rare")]
    q = spark.createDataFrame(q, "query_id long, query string")
    want = sorted(map(tuple, search.batch_bm25(m, q, 10).select("query_id", "n", "id", "rank").collect()))
    assert sum(x[0] == 90 for x in want) == 10
    for args in ({}, {"shard_rows": 20, "block_queries": 7}):
        assert sorted(map(tuple, search.many_bm25(m, q, 10, **args).select("query_id", "n", "id", "rank").collect())) == want
    assert not search.many_bm25(m, q.where("false"), 10).collect() and not search.many_bm25(m.where("false"), q, 10).collect()


def test_groups_in_turn_are_the_greedy_groups():
    import random

    r = random.Random(11)
    for _ in range(60):
        rows = [{"norm": "".join(r.choices("ab (", k=r.choice((0, 4, 12, 30)))), "path": r.choice(("a/b.py", "b.py", "c/d.js")), "kind": r.choice("fg")} for _ in range(25)]
        grouper, want = chunking.Grouper(0.7), {}
        for i, x in enumerate(rows):
            want.setdefault(grouper.add(x), []).append(i)
        assert list(chunking.groups_in_turn(rows, 0.7)) == list(want.values())


def test_recall_writes_no_code(spark, monkeypatch):
    # the code of a row went to disk once for every edit that finds it, and once more in chunks
    columns = []
    monkeypatch.setattr(recall, "written", lambda df, label, w=recall.written: columns.extend(df.columns) or w(df, label))
    m = spark.createDataFrame([(str(i), "src/a.py", f"def load_thing(x):\n    return x + {i}\n", None, 0) for i in range(3)], "id string, file_path string, new_code string, context string, at_us long")
    p = spark.createDataFrame([(i, "src/a.py", "def load_thing(y):\n    return y\n", "Edit") for i in range(4)], "change_id long, file_path string, new_code string, tool_type string")
    got = recall.recall(m, p, F.lit("1970-01-02 00:00:00+00:00").cast("timestamp"), F.lit("src")).collect()
    assert len(got) == 4 and columns and not {"new_code", "code"} & set(columns)


def test_recall_falls_back_to_previews(spark):
    m = spark.createDataFrame([(str(i), f"far/away/x{i}.py", f"def load_thing(x):\n    return {'9' * 500}\n", None, 0) for i in range(5)], "id string, file_path string, new_code string, context string, at_us long")
    p = spark.createDataFrame([(1, "src/a.py", "def load_thing(y):\n    return y\n", "Edit")], "change_id long, file_path string, new_code string, tool_type string")
    now = F.lit("2025-01-06 00:00:00+00:00").cast("timestamp")
    hits = search.batch_bm25(m, recall.pending_terms(p), 10).join(m, "id")
    r = recall.previews(hits, spark.createDataFrame([], "query_id long")).first()
    assert r.text.count("**From:**") == 3 and r.text.count("... (truncated)") == 3
    got = {x.query_id for x in recall.recall(m, p, now, F.lit("src"), fallback=True).collect()}
    assert got == {1}
