"""Conversation repair against plain dynamic programming over whole conversations, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from metaloom.llm import conversation, entry

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        draw = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if draw == 1 else re.sub(r"[.!?]", "", text) if draw == 2 else text
        out += [] if draw == 0 else [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def plain_report(rows):
    """One conversation's report; every cheapest edit string is kept for each number of rows taken and last initial."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, faults, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit, out) in list(states.items()):
                for c in follows[last]:
                    if c != "s":
                        new = (cost + 3, audit + "I", (*out, (names[c], "")))
                        states[c] = min(states.get(c, new), new)
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for last, (cost, audit, out) in inserted(states).items():
            steps = [(last, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                due = 3 if fault else 0
                for c in follows[last]:
                    if role[:1] == c:
                        steps.append((c, (cost + due, audit + "K", (*out, (role, text)))))
                    if c != "s":
                        steps.append((c, (cost + due + 3, audit + "R", (*out, (names[c], text)))))
            for c, new in steps:
                after[c] = min(after.get(c, new), new)
        states = after
    cost, audit, out = min(v for c, v in inserted(states).items() if c in ("", "a"))
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain(rows, damage=True):
    after = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return {conv: plain_report([r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


def same(got, want):
    got = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert got.keys() == want.keys()
    bad = [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    assert not bad, bad[:2]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No", "", " \n", None, f"t{turn}!", f"t{turn}", "é: ü?"])))
    return rows


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(entry.op12_conversation_repair(spark, "/root/testdata/sf0.01"), plain(rows))


def test_search_finds_the_least_of_all_edit_strings():
    """Against all strings of up to two insertions a gap, for every sequence of three rows."""
    codes = [("u", False), ("a", False), ("s", False), ("u", True), ("x", False)]
    for rows in itertools.product(codes, repeat=3):
        found = []
        for edits in itertools.product("DKR", repeat=3):
            for ins in itertools.product(range(3), repeat=4):
                audit = "".join("I" * k + e for k, e in zip(ins, edits, strict=False)) + "I" * ins[3]
                state, cost, ok, i = conversation.START, 0, True, 0
                for letter in audit:
                    if letter == "K":
                        state = conversation.STEP.get((state, rows[i][0]))
                        cost += 3 * rows[i][1]
                    elif letter == "D":
                        cost += 4
                    else:
                        state = conversation.WANTED[state][1]
                        cost += 3 + 3 * (letter == "R" and rows[i][1])
                    if state is None:
                        ok = False
                        break
                    i += letter != "I"
                if ok and state in (conversation.START, conversation.A):
                    found.append((cost, audit))
        assert conversation.cheapest(rows, conversation.START, None) == min(found)


def test_random_conversations(spark):
    rows = random_rows(1, 300, 9)
    same(conversation.reports(conversation.repair(conversation.damaged(frame(spark, rows))), frame(spark, rows)), plain(rows))
    same(conversation.reports(conversation.repair(frame(spark, rows)), frame(spark, rows)), plain(rows, damage=False))


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_give_what_whole_conversations_give(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation, "PIECE_ROWS", piece)
    rows = random_rows(2, 6, 9) + [(9, t, random.Random(t).choice(["user", "assistant"]), f"text {t % 150}" + ("." if t % 7 else "")) for t in range(700)]
    pieces = conversation.repair(frame(spark, rows)).persist()
    assert pieces.where("conv_id = 9").count() > 1
    same(conversation.reports(pieces, frame(spark, rows)), plain(rows, damage=False))


def test_copies_beyond_the_bound_are_combined(spark, monkeypatch):
    monkeypatch.setattr(conversation, "COPIES", 20)
    rows = [(1, 0, "user", "same.")] * 60 + [(1, 5, "user", "same.")] * 30 + [(1, 1, "assistant", "")] * 40 + [(1, 2, "assistant", "b.")] * 3 + [(None, None, None, None)] * 25 + [(2, 1, "user", "same.")]
    same(conversation.reports(conversation.repair(frame(spark, rows)), frame(spark, rows)), plain(rows, damage=False))


def test_edges(spark):
    rows = [(1, 1, "user", "x" * 200_000), (1, 2, "assistant", "y" * 200_000 + ".")] + [(None, None, None, None), (None, 3, "user", "Hi."), (2, None, "", "no role."), (3, 1, "assistant", "only."), (4, 1, "system", "alone.")]
    same(conversation.reports(conversation.repair(frame(spark, rows)), frame(spark, rows)), plain(rows, damage=False))
    none = frame(spark, rows).limit(0)
    assert conversation.reports(conversation.repair(none), none).count() == 0
    got = conversation.reports(conversation.repair(none), frame(spark, rows[:2])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
