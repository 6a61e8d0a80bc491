"""Repairs against a plain search over all edits, whatever the blocks and the fan of the tree."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from canopy.llm import repair as R

NULLS = lambda x: " " if x is None else x


def damage(rows):
    """Rows (turn, role, text) of one conversation after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{NULLS(conv)}:{NULLS(turn)}".encode()) % 20
        role, text = NULLS(role), NULLS(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(out, key=key)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, kinds):
    """Least (cost, audit), by the least-cost prefixes of every length of role sequence: a search over whole paths, no matrices."""
    ways = {"": {(0, "")}}  # roles so far, as far as they matter: whether empty, and the last initial

    def insert(ways):
        todo = list(ways.items())
        out = {k: set(v) for k, v in ways.items()}
        for _ in range(3):
            new = []
            for last, found in todo:
                nxt = "a" if last == "u" else "u"
                made = {(c + 2, a + "I") for c, a in found}
                out.setdefault(nxt, set()).update(made)
                new.append((nxt, made))
            todo = new
        return out

    def least(ways):
        out = {}
        for k, v in ways.items():
            best = min(c for c, _ in v)
            out[k] = {x for x in v if x[0] <= best}  # every audit of the least cost
        return out

    ways = least(insert(ways))
    for initial, kind in zip(initials, kinds, strict=True):
        new = {}
        for last, found in ways.items():
            for c, a in found:
                new.setdefault(last, set()).add((c + 3, a + "D"))
                if kind in ("blank", "duplicate"):
                    continue
                extra = kind == "truncated"
                allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                if initial in allowed and initial:
                    new.setdefault(initial, set()).add((c + extra, a + "K"))
                for r in "ua":
                    if r in allowed:
                        new.setdefault(r, set()).add((c + 2 + extra, a + "R"))
        ways = least(insert(new))
    return min(x for k in ("", "a") for x in ways.get(k, ()))


def every_script(initials, kinds):
    """All scripts with up to three insertions in each gap, for very short conversations."""
    best = None
    for letters in itertools.product("KRD", repeat=len(initials)):
        for gaps in itertools.product(range(4), repeat=len(initials) + 1):
            for wanted in itertools.product("ua", repeat=sum(gaps) + letters.count("R")):
                roles, cost, audit, free = "", 0, "", iter(wanted)
                ok = True
                for i in range(len(initials) + 1):
                    for _ in range(gaps[i]):
                        roles, cost, audit = roles + next(free), cost + 2, audit + "I"
                    if i == len(initials):
                        break
                    x, kind = letters[i], kinds[i]
                    audit += x
                    if x == "D":
                        cost += 3
                        continue
                    ok &= kind not in ("blank", "duplicate")
                    cost += (kind == "truncated") + 2 * (x == "R")
                    roles += next(free) if x == "R" else initials[i] or "-"
                if ok and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def expected(all_rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        rows = damage([r for r in all_rows if r[0] == conv])
        kinds = faults(rows)
        initials = [r[1][:1] for r in rows]
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(initials, kinds)
        text = "\n".join(R.repaired([(r, t) for _, r, t in rows], audit))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)


def test_search_equals_every_script():
    dice = random.Random(3)
    for n in (0, 1, 2):
        for initials in itertools.product(["s", "u", "a", "x", ""], repeat=n):
            kinds = [dice.choice(["", "truncated", "blank", "duplicate"]) for _ in range(n)]
            want = every_script(initials, kinds)
            assert cheapest(initials, kinds) == want
            whole = R.Part(R.UNIT)
            parts = [R.part(i, k, None, 1) for i, k in zip(initials, kinds, strict=True)]
            for p in parts:
                whole = p if whole.matrix is R.UNIT else R.join(whole, p)
            found = R.result(whole)
            assert (found["cost"], found["audit"]) == want


def test_product_is_associative():
    dice = random.Random(4)
    rows = [R.part(dice.choice(["s", "u", "a", "x"]), dice.choice(["", "", "truncated", "blank", "duplicate"]), i, dice.choice([1, 1, 2])) for i in range(40)]
    for _ in range(20):
        left = rows
        while len(left) > 1:
            i = dice.randrange(len(left) - 1)
            left = [*left[:i], R.join(left[i], left[i + 1]), *left[i + 2 :]]
        once = rows[0]
        for r in rows[1:]:
            once = R.join(once, r)
        assert left[0] == once


def test_lines_follow_the_audit():
    assert R.repaired([("user", "a."), ("tool", "b."), ("user", "c.")], "KRKI") == ["user:a.", "assistant:b.", "user:c.", "assistant:"]
    assert R.repaired([("system", "a."), ("assistant", "b."), ("user", "")], "KIKD") == ["system:a.", "user:", "assistant:b."]
    assert R.repaired([("system", "a.")], "D") == R.repaired([], "") == []


@pytest.mark.parametrize(("block", "fan"), [(1, 2), (3, 2), (2048, 16)])
def test_repair_equals_search(spark, block, fan):
    dice = random.Random(block)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "unknown"], ["", "  \t", "Yes.", "No!", "why", "What?  ", "done. \x0b", None, "a" * 3000 + "."]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(dice.choice([1, 2, 5, 9, 30])):
            rows.append((conv, dice.choice([turn, turn, turn, None, turn * 3]), dice.choice(roles), dice.choice(texts)))
    rows += [rows[0]] * 3 + [(50, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(90)] + [(51, 7, "user", "again and again.")] * 70
    assert got(R.repair(frame(spark, rows), block, fan)) == expected(rows)


def test_conversations_that_are_dropped_or_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = got(R.repair(frame(spark, [(gone, 1, "user", "x.")])))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repair(frame(spark, [])).collect() == []
    wide = frame(spark, [(1, 1, "user", "x."), (1, 2, "assistant", "y.")]).selectExpr("*", "1 as at", "'z' as audit", "conv_id as copies")
    assert set(got(R.repair(wide))) == {1}


def test_query_equals_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(R.op12_conversation_repair(spark, sf_dir)) == expected(rows)
