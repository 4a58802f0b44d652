"""Conversation repair against the SQL and against trying all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from spikegrid.llm import conversations
from spikegrid.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import sorted_rows
from tests.oracle import compare, connect

TURNS = "conv_id long, turn long, role string, text string, row string, place long, piece int, fault string, cost string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = SPACE.sub("", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest edits by trying them all, up to three inserted rows between two others."""
    best = None
    kinds = faults(rows)
    choices = [[("D", None)] if k in ("blank", "duplicate") else [("D", None), ("K", r[2]), ("R", "user"), ("R", "assistant")] for k, r in zip(kinds, rows)]
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picked in itertools.product(*choices):
        base = sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (k == "truncated" and e != "D") for (e, _), k in zip(picked, kinds))
        if best and base > best[0]:
            continue
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, filled))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k, before in enumerate(filled):
                audit += "I" * len(before)
                lines += [(r, "") for r in before]
                if k < len(rows):
                    audit += picked[k][0]
                    if picked[k][0] != "D":
                        lines.append((picked[k][1], rows[k][3]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (not best or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best or (0, "", [])


def plain_audit(rows, original):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        kinds, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = plain_repair(mine)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], TURNS)


def short_conversations(seed, n=60, most=4):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["a.", "b!", "c", "a.", " ", "", None, "d?\n "]
    ids = [None, *range(n)]
    return [(c, rng.choice([None, 0, 1, 2, 5]) if rng.random() < 0.3 else k, rng.choice(roles), rng.choice(texts)) for c in ids for k in range(rng.randrange(1, most + 1))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert compare(QUERIES["op12_survivor_coalescence"](spark, d), connect(d), ORACLE["op12_survivor_coalescence"]) is None


@pytest.mark.parametrize("piece", [conversations.ROWS, 7])
def test_all_edits_of_short_conversations(spark, piece):
    rows = short_conversations(1)
    table = frame(spark, rows)
    assert sorted_rows(conversations.damaged(table).collect()) == sorted_rows(plain_damage(rows))
    plain_rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted_rows(conversations.audit(table, rows=piece).collect()) == sorted_rows(plain_audit(plain_rows, rows))


@pytest.mark.parametrize("seed", range(3))
def test_pieces_change_nothing(spark, seed):
    """A conversation cut into many pieces, and with stretches that stay unresolved for long."""
    rng = random.Random(seed)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", " ", f"{k}.", f"{k}", f"{k}!"])) for k in range(300)]
    rows += [(2, k, "user" if k % 2 else "assistant", f"{k}") for k in range(150)] + [(3, 0, "user", "same.")] * 200 + [(None, None, "user", "x.")] * 30
    table = frame(spark, rows)
    one, many = (sorted_rows(conversations.audit(table, rows=p).collect()) for p in (conversations.ROWS, 11))
    assert one == many
    done = conversations.repair(table, 11)
    assert done.edits.where("conv_id = 1").select("piece").distinct().count() > 10
    for conv in (1, 2, 3):
        roles = "".join(r.role[0] for r in conversations.repaired(done).where(f"conv_id = {conv}").orderBy("place", "no").collect())
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_edits_leave_memory_early():
    run, most, out = conversations.Survivors(0), 0, 0
    for k in range(10_000):
        run.step(conversations.MOVES["ua"[k % 2], ""])
        out += len(list(run.shared()))
        most = max(most, k + 1 - out)
    assert most < 10


def test_awkward_tables(spark):
    empty = frame(spark, [(1, 1, "user", "x")]).where("false")
    assert conversations.audit(empty).collect() == []
    gone = conversations.audit(empty, frame(spark, [(7, 1, "user", "x")])).collect()
    assert [tuple(r) for r in gone] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = frame(spark, [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "ok.")])
    assert conversations.audit(long).first().audit == "KK"
