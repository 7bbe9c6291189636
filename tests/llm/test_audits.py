"""Conversation repair against brute force over all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from burdenflow.llm import audits
from burdenflow.llm.audits import Audit, comes_before, repair_audits

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv_id] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Every edit sequence with at most enough inserts, by cost and then by letters."""
    best = None

    def go(at, letters, cost, shape, lines, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", shape):
                found = (cost, letters, lines)
                best = found if best is None or found[:2] < best[:2] else best
        else:
            _, role, text = rows[at]
            go(at + 1, letters + "D", cost + 2, shape, lines, 0)
            if faults[at] not in "bd":
                extra = 5 * (faults[at] == "t")
                if role:
                    go(at + 1, letters + "K", cost + extra, shape + role[0], lines + [f"{role}:{text}"], 0)
                for name in ("user", "assistant"):
                    go(at + 1, letters + "R", cost + 1 + extra, shape + name[0], lines + [f"{name}:{text}"], 0)
        if inserts < 2:
            for name in ("user", "assistant"):
                go(at, letters + "I", cost + 5, shape + name[0], lines + [f"{name}:"], inserts + 1)

    go(0, "", 0, "", [], 0)
    return best


def brute(rows, hurt=True):
    out = {}
    for conv_id, own in (damage(rows) if hurt else rows).items():
        faults = faults_of(own)
        cost, letters, lines = cheapest(own, faults)
        turns = [t for t, _, _ in own if t is not None]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows) and df.columns == audits.RESULT
    return found


def some_rows(seed, conversations=60, most=6):
    rng = random.Random(seed)
    words = ["One.", "Two", "Three!", " ", "", None, "Four?\n", "five\t", "six. "]
    rows = []
    for conv_id in [*range(conversations), None]:
        for turn in range(rng.randrange(1, most)):
            turn = rng.choice([turn, turn, turn, 2 * turn, None])
            rows.append((conv_id, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(words)))
    return rows


def test_against_all_edit_sequences(spark):
    rows = some_rows(1)
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS segment", "'x' AS head", "true AS dropped")
    assert got(repair_audits(extra)) == brute(rows)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_segments_give_the_same(spark, most):
    """Conversations cut into segments of a few rows, also over tasks."""
    rows = some_rows(2, 40, 8)
    assert got(repair_audits(spark.createDataFrame(rows, SCHEMA), rows=most)) == brute(rows)


def test_one_conversation_in_many_tasks(spark):
    """A conversation of all rows is dealt out; the result is that of one pass over its rows."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Row {t}.", f"Row {t}", "Same.", ""])) for t in range(3000)]
    own = damage(rows)[7]
    faults = faults_of(own)
    paths = audits.segment_paths([r[:1] for _, r, _ in own], "".join(faults), (0,))
    cost, letters = min((c, a) for _, end, c, a in paths if end in audits.FINAL)
    found = got(repair_audits(spark.createDataFrame(rows, SCHEMA).repartition(16)))[7]
    assert found[1:4] == (faults.count("b"), faults.count("d"), faults.count("t")) and found[5:7] == (cost, letters)
    lines, _ = audits.repaired([r for _, r, _ in own], [t for _, _, t in own], letters, 0)
    assert found[7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_nothing(spark):
    assert got(repair_audits(spark.createDataFrame([], SCHEMA))) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(repair_audits(spark.createDataFrame([(1, dropped, "user", "Hello.")], SCHEMA))) == {1: (0, 0, 0, 0, 0, 0, "", empty)}


def test_long_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 400_000 + ".") for t in range(6)]
    assert got(repair_audits(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_order_of_audits(monkeypatch):
    """Linked audits are ordered as their letters are, whatever the hashes say."""
    rng = random.Random(4)
    for modulus in (audits.MODULUS, 3):  # with a modulus of three most hashes collide
        monkeypatch.setattr(audits, "MODULUS", modulus)
        nodes = [Audit(None, "")]
        for _ in range(150):
            nodes.append(Audit(rng.choice(nodes), "".join(rng.choice("DK") for _ in range(rng.randrange(3)))))
        for a, b in itertools.product(nodes, nodes):
            assert comes_before(a, b) == ("".join(a.pieces()) < "".join(b.pieces()))
