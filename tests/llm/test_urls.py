"""URL rules against plain Python, and mining against brute-force counting."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from canopy.llm import urls


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def fixed(host, path):
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query_rules(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = {r["page_id"]: r for r in urls.op9_url_association_rules(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, url in pages.items():
        host, path = parse(url)
        rule, verdict = fixed(host, path)
        row = got[i]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")
        assert (row["mined_rule"] is None) or rule is None


def brute(rows, support, confidence):
    """Association rules of all token sets, counted one by one."""
    n, found = len(rows), {}
    seen = {c for tokens, _ in rows for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    for c in seen:
        with_c = [v for t, v in rows if set(c) <= set(t)]
        for verdict in set(with_c):
            hits = with_c.count(verdict)
            if hits / n >= support and hits / len(with_c) >= confidence:
                found[c, verdict] = hits / len(with_c)
    return found


def pruned(found):
    def worse(c, v):
        return any(set(d) < set(c) and w == v and found[d, w] >= found[c, v] for d, w in found)

    return {k for k in found if not worse(*k)}


def labelled():
    rows = []
    for k in range(120):
        tokens = [f"a{k % 3}", f"b{k % 4}", *(["x"] if k % 5 == 0 else []), *(["y"] if k % 7 < 3 else [])]
        rows.append((tokens, "block" if (k % 3 == 0 and k % 4 == 1) or k % 5 == 0 else "allow"))
    return rows


def test_mining_and_pruning_equal_counting(spark):
    rows = labelled()
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9)
    want = brute(rows, 0.02, 0.9)
    got = {(tuple(r["rule_tokens"]), r["verdict"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(tuple(r["rule_tokens"]), r["verdict"]) for r in urls.prune(mined).collect()} == pruned(want)


def test_matching_equals_trying_every_rule(spark):
    rows = labelled()
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(999, ["zzz"]), (1000, [])], "k int, tokens array<string>")
    rules = urls.prune(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9))
    rules = rules.select("rule_tokens", "verdict", "confidence", "support").collect()
    table = spark.createDataFrame(rules, "rule_tokens array<string>, verdict string, confidence double, support double")
    got = {r["k"]: (r["mined_verdict"], r["mined_rule"]) for r in urls.match(frame, table).collect()}
    for i, tokens in [*enumerate(t for t, _ in rows), (999, ["zzz"]), (1000, [])]:
        fired = [(r["confidence"], r["support"], len(r["rule_tokens"]), r["verdict"], " ".join(r["rule_tokens"])) for r in rules if set(r["rule_tokens"]) <= set(tokens)]
        best = max(fired, default=None)
        assert got[i] == ((best[3], best[4]) if best else ("allow", None))


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "://", "http://", "HTTP://ExAmple.COM/en/x?y#z", "a://b://c", "https://www.example.com#/en/", "ftp://x.net/es/\nfoo", "http://ÄB.Net/fr/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(odd)] + [(1, "", "x", "y")], "page_id int, url string, tokens string, verdict string")
    labels = urls.rule_labels(pages)
    got = urls.judge(pages, labels).collect()
    assert len(got) == 11
    for r in got:
        host, path = parse(odd[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, fixed(host, path)[0])
    assert urls.judge(pages.limit(0), labels).collect() == []
    no_labels = urls.judge(pages.where(F.col("page_id") < 5), labels.limit(0)).collect()
    assert {r["verdict"] for r in no_labels} == {"allow"}


def test_long_rules_and_late_tokens_are_mined(spark):
    """A verdict that only six steps together give, and one that hangs on the 80th token of a URL."""
    rows = []
    for k in range(64):
        steps = [f"s{'abcdef'[b]}{'ny'[(k >> b) & 1]}" for b in range(6)]
        rows += [("http://a.org/" + "/".join(steps), "block" if k == 63 else "allow")] * 3
    deep = "/".join(f"d{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(80))
    rows += [(f"http://b.org/{deep}/{'bad' if k % 2 else 'good'}", "block" if k % 2 else "allow") for k in range(40)]
    labels = spark.createDataFrame(rows, "url string, verdict string")
    pages = labels.select(F.col("url"), F.monotonically_increasing_id().alias("page_id"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, rules=[]).collect()}
    want = {r["page_id"]: dict(rows)[r["url"]] for r in pages.collect()}
    assert got == want


def test_a_path_that_always_comes_whole_is_one_item(spark):
    """Thirty steps of one path give one item, not 2^30 item sets; a URL with some of them has it too."""
    path = "/".join(f"step{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    rows = [(f"http://x.org/{path}", "block")] * 40 + [(f"http://y{k}.org/z", "allow") for k in range(60)]
    labels = spark.createDataFrame(rows, "url string, verdict string")
    rules, names = urls.learn(labels)
    assert rules.count() < 100 and names.count() > 30
    pages = spark.createDataFrame([(1, "http://q.org/stepc/other"), (2, "http://q.org/none")], "page_id int, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, rules=[]).collect()} == {1: "block", 2: "allow"}


def tokens(host, path):
    labels = host.split(".")[::-1]
    found = [f"h{i}:{x}" for i, x in enumerate(labels)] + ["w:" + w for w in re.findall("[a-z0-9]+", host)]
    return frozenset(found + ["p:" + re.sub("[0-9]+", "0", p) for p in path.split("/") if p])


def test_query_verdicts_equal_brute_force(spark, sf_dir):
    """The mined verdict of every page that no fixed rule decides, from rules counted in plain Python."""
    pages = {r["page_id"]: parse(r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    known = [(tokens(*p), fixed(*p)[1]) for p in pages.values() if fixed(*p)[1]]
    least, where = urls.SUPPORT * len(known), {}
    for k, (some, _) in enumerate(known):
        for t in some:
            where.setdefault(t, set()).add(k)
    groups = {}
    for t, rows in where.items():
        if len(rows) >= least:
            groups.setdefault(frozenset(rows), []).append(t)
    name = {t: min(group) for group in groups.values() for t in group}
    rows_of = {min(group): rows for rows, group in groups.items()}
    blocked = {k for k, (_, v) in enumerate(known) if v == "block"}
    found, level = {}, {frozenset([t]): rows for t, rows in rows_of.items()}
    while level:  # item sets one item larger each time
        for items, rows in level.items():
            for verdict, good in (("block", len(rows & blocked)), ("allow", len(rows - blocked))):
                if good >= least and good / len(rows) >= urls.CONFIDENCE:
                    found[tuple(sorted(items)), verdict] = (good / len(rows), good / len(known))
        larger = {}
        for items, rows in level.items():
            for t, more in rows_of.items():
                if t > max(items) and len(rows & more) >= least:
                    larger[items | {t}] = rows & more
        level = larger
    left = pruned({k: c for k, (c, _) in found.items()})
    got = {r["page_id"]: r for r in urls.op9_url_association_rules(spark, sf_dir).collect()}
    for i, p in pages.items():
        if fixed(*p)[1] is None:
            items = {name[t] for t in tokens(*p) if t in name}
            fired = [(*found[k], len(k[0]), k[1], " ".join(k[0])) for k in left if set(k[0]) <= items]
            best = max(fired, default=(0, 0, 0, "allow", None))
            assert (got[i]["verdict"], got[i]["mined_rule"]) == best[3:]


def test_prune_looks_at_all_subsets(spark):
    rules = [(["a"], "block", 0.95, 0.5), (["a", "b", "c"], "block", 0.91, 0.1), (["a", "b", "d"], "block", 0.97, 0.1), (["b", "c"], "allow", 1.0, 0.1), (["e"], "allow", 0.9, 0.1), (["e", "f"], "block", 0.9, 0.1)]
    got = urls.prune(spark.createDataFrame(rules, "rule_tokens array<string>, verdict string, confidence double, support double")).collect()
    assert {"".join(r["rule_tokens"]) for r in got} == {"a", "abd", "bc", "e", "ef"}
