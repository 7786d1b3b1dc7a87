"""Conversation repair: edits, faults and digests against a plain dynamic program, in one block and over many."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from budgetlens.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, block long, conv string, audit int, present boolean"
WS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """(conv_id, turn, role, text, present) with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(c, t, r, x, 5, "y", 7, p) for c, t, r, x, p in rows], SCHEMA)


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, must go, broken) rows: the least audit of the cheapest, state by state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(2):
            for s in list(best):
                c, a, r = best[s]
                new = (c + 2, a + "I", [*r, f"{name[after[s]]}:"])
                if after[s] not in best or new < best[after[s]]:
                    best[after[s]] = new
        return best

    best = {"": (0, "", [])}
    for role, text, gone, broken in rows:
        new = {}
        for s, (c, a, r) in inserts(dict(best)).items():
            edits = [(s, c + 3, a + "D", r)]
            if not gone:
                edits.append((after[s], c + 2 + broken, a + "R", [*r, f"{name[after[s]]}:{text}"]))
                if (s, role[:1]) in step:
                    edits.append((step[s, role[:1]], c + broken, a + "K", [*r, f"{role}:{text}"]))
            for to, *rest in edits:
                new[to] = min(new.get(to, (10**9,)), tuple(rest))
        best = new
    best = inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, tie):
    """``tie`` orders rows of one conversation, turn and role."""
    convs = defaultdict(list)
    for c, t, r, x, p in rows:
        convs[c] += [(t, " " if r is None else r, " " if x is None else x)] if p else []
    out = []
    for c, own in convs.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], tie(v[2])))
        seen, faults, plan = set(), Counter(), []
        for _, r, x in own:
            end = x.rstrip(WS)
            fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((r, x))
            faults[fault] += 1
            plan.append((r, x, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, fixed = cheapest(plan)
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return Counter(out)


def got(pieces):
    return Counter(map(tuple, repair.conversations(pieces).collect()))


@pytest.fixture(scope="module")
def tie(spark):
    texts = {x: h for x, h in spark.createDataFrame([(x,) for x in TEXTS], "x string").selectExpr("x", "xxhash64(x)").collect()}
    return texts.__getitem__


TEXTS = ["", " ", "\n\t", "Yes.", "No", "Why?!  ", "é", "日本.", "well, no", *(f"text {k}." for k in range(40)), *(f"broken {k}" for k in range(9)), "long. " * 5000]


def conversation_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            role = rng.choice(["system", "s", "tool", "", None, "User"]) if rng.random() < 0.15 else role
            text = rng.choice(TEXTS + [None])
            turn = None if rng.random() < 0.05 else t + rng.randrange(2) * rng.randrange(3)
            rows += [(c, turn, role, text, rng.random() > 0.1 if rng.random() < 0.9 else None)] * rng.choice([1, 1, 1, 1, 2])
    return rows


def test_repairs_match_the_plain_program(spark, tie):
    rows = conversation_rows(1, 300) + [(None, 0, "user", "Yes.", True), (None, None, None, None, True), (9000, 1, "user", "No", False), (9001, None, "assistant", "é", True)]
    df = frame(spark, rows)
    assert got(repair.repair(df, present_col="present")) == brute(rows, tie)
    whole = [(*r[:4], True) for r in rows]
    assert got(repair.repair(df)) == brute(whole, tie)


@pytest.mark.parametrize("limits", [(1, 1 << 20), (3, 1 << 20), (50, 100)])
def test_conversations_over_many_blocks_match(spark, tie, limits):
    rng = random.Random(limits[0])
    rows = conversation_rows(7, 40)
    for t in range(200):  # one conversation holds most rows, one turn of it many equal ones
        rows.append((20, t // 2 if t % 7 else None, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(TEXTS[:-1]), rng.random() > 0.1))
    rows += [(20, 30, "user", "text 3.", True)] * 60
    pieces = repair.repair(frame(spark, rows), present_col="present", block_rows=limits[0], block_bytes=limits[1])
    assert got(pieces) == brute(rows, tie)
    assert pieces.where("conv = 20").count() > 5


def test_empty_table_and_absent_rows(spark, tie):
    assert got(repair.repair(frame(spark, []))) == Counter()
    rows = [(3, 1, "user", "Yes.", False), (3, 2, "user", "No", False)]
    empty = hashlib.sha256(b"").hexdigest()
    assert got(repair.repair(frame(spark, rows), present_col="present")) == Counter([(3, 0, 0, 0, 0, 0, 0, "", empty)])


def test_repaired_roles_are_right_and_edits_are_true(spark):
    rows = conversation_rows(3, 100)
    for r in repair.repair(frame(spark, rows), present_col="present").where("block = 0").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.repaired))
        assert len(r.repaired) == len(r.audit) - r.audit.count("D")


def test_ranks_order_all_audits():
    rng = np.random.default_rng(5)
    for _ in range(50):
        kind = rng.integers(0, 9, rng.integers(0, 12))
        first = np.array([0, len(kind)])
        paths = repair.Paths(kind, first, repair.ENDS[None, :], np.array([True]))
        letter = {k: c for k, c in enumerate("suax")}
        node, count = paths.nodes(np.array([0]))
        audit = repair.LETTERS[paths.letter[node]].tobytes().decode()
        plan = [(letter[k % 4] if k < 8 else "x", "", k == 8, int(4 <= k < 8)) for k in kind.tolist()]
        assert (paths.cost[0, 0], audit) == cheapest(plan)[:2] and count[0] == len(audit)
