"""Conversation repair against an exhaustive search of edits, and filter interactions against plain counting."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from slopewise.llm import repair as rp
from slopewise.llm.interactions import Counters, document_interactions, interactions

ROLES = ["user", "assistant", "system", " ", "tool"]
TEXTS = ["Hi.", "Why? ", "no end", " \n", "", "Done! ", "x."]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\r\x0b\x0c")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, result) of all edit sequences with at most one insertion at each place."""
    kinds = faults(rows)

    def go(i, said, cost, audit, inserted):
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)):
                yield cost, audit, said
        else:
            role, text = rows[i]
            yield from go(i + 1, said, cost + 2, audit + "D", False)
            if kinds[i] not in ("blank", "duplicate"):
                more = cost + 5 * (kinds[i] == "truncated")
                yield from go(i + 1, [*said, (role, text)], more, audit + "K", False)
                for r in ("user", "assistant"):
                    yield from go(i + 1, [*said, (r, text)], more + 1, audit + "R", False)
        if not inserted:
            for r in ("user", "assistant"):
                yield from go(i, [*said, (r, "")], cost + 5, audit + "I", True)

    return min(go(0, [], 0, "", False), key=lambda x: x[:2])


def conversations():
    pick = random.Random(3)
    return [[(pick.choice(ROLES[: pick.choice([2, 3, 5])]), pick.choice(TEXTS)) for _ in range(pick.randrange(6))] for _ in range(120)]


def by_hand(rows):
    c = rp.Conversation(1)
    for k, (role, text) in enumerate(rows):
        c.add(k, role, text)
    return c.summary()


@pytest.mark.parametrize("stretch", [2, 256])
def test_cheapest_repair_with_the_least_audit(monkeypatch, stretch):
    monkeypatch.setattr(rp, "STRETCH", stretch)
    for rows in conversations():
        cost, audit, said = every_repair(rows)
        got = by_hand(rows)
        assert (got[6], got[7]) == (cost, audit), rows
        assert got[8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def test_long_conversation_is_taken_in_stretches(monkeypatch):
    pick = random.Random(9)
    rows = [(pick.choice(ROLES[:3]), f"{pick.randrange(900)}{pick.choice(['.', '?', ''])}") for _ in range(3000)]
    short = by_hand(rows)
    monkeypatch.setattr(rp, "STRETCH", 10_000)
    assert by_hand(rows) == short


def test_rows_through_spark(spark):
    rows = [(k, n, role, text) for k, c in enumerate(conversations()) for n, (role, text) in enumerate(c)]
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (None, 7, "assistant", "Yes."), (500, 2, "user", "Same."), (500, 2, "user", "Same."), (501, 0, "user", "x" * 300_000 + ".")]
    table = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, edit string, cost int").repartition(4)
    got = {r.conv_id: r for r in rp.repair(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, c in enumerate(conversations()):
        if c:
            assert (got[k].cost, got[k].audit) == every_repair(c)[:2]
    odd = got[None]
    assert (odd.gaps, odd.blank, odd.illegal, odd.cost, odd.audit) == (3, 1, 1, 2, "DKK")
    assert (got[500].duplicate, got[500].gaps, got[500].audit) == (1, 0, "DD")
    turns = rp.repaired_turns(table).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("t")).collect()
    for r in turns:
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.t).encode()).hexdigest() == got[r.conv_id].repaired_sha256
        assert [x.position for x in r.t] == list(range(len(r.t)))
    nobody = rp.repair(table, present=F.lit(False)).filter("conv_id = 3").first()
    assert (nobody.cost, nobody.audit, nobody.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert rp.repair(table.limit(0)).count() == 0 and rp.repaired_turns(table.limit(0)).count() == 0


def test_counters_hold_large_counts():
    c = Counters(3, 1)
    total = c.unpack(sum((1 << 58) * p for p in c.packed))
    assert total.shape == (5, 6, 3) and total[0, 0, 2] == 2 << 58 and (total >= 0).all()


def test_interactions_against_counting(spark, odd_rows):
    pick = random.Random(2)
    docs = [(i, t, pick.choice(["a", "b", None])) for i, t in odd_rows]
    docs += [(300 + k, "Ab $ " + "word " * (k * 9), pick.choice(["a", "", "c"])) for k in range(60)] + [(None, None, "a"), (2, "", "b"), (2, "", "b")]
    labels = [(i, pick.randrange(2), pick.randrange(2)) for i in range(0, 360, 3)] + [(6, 1, None), (6, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    got = document_interactions(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    want = defaultdict(Counter)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and low[t] < i}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels if i is not None) for k in (1, 2))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = want[s or "", "".join(order), step]
                c["removed"] += fails[f] and not gone
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += fails[f] and not gone and good
                c["toxic_lost"] += fails[f] and not gone and toxic
                gone |= fails[f]
                c["kept"] += not gone
    share = Counter()
    for (part, order, step), c in want.items():
        share[part, order[step - 1]] += c["removed"]
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in docs})
    for r in got:
        c = want[r.part, r.filter_order, r.step]
        assert all(r[m] == c[m] for m in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), r
        assert r.shapley == share[r.part, r.filter_order[r.step - 1]]
    assert document_interactions(table.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_interactions_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, 3), ("p", True, True, 2), ("q", None, True, 1)], "part string, long boolean, odd boolean, n int")
    got = {(r.part, r.filter_order, r.step): r for r in interactions(rows, "part", {"L": F.col("long"), "O": F.col("odd")}, {}, F.col("n")).collect()}
    assert (got["p", "LO", 1].removed, got["p", "LO", 2].removed, got["p", "LO", 2].redundant, got["p", "OL", 2].removed, got["p", "OL", 2].shapley) == (5, 0, 2, 3, 8)
    assert (got["q", "LO", 1].kept, got["q", "LO", 2].unique_fails) == (1, 1)
