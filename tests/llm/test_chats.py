"""Conversation repair against a search over all edits, and against a plain programme over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidepanel.llm import chats as CH
from tidepanel.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(own):
    seen, out = set(), []
    for _, _, role, text in own:
        ended = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not ended else "duplicate" if (role, text) in seen else None if ended[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(own, marks):
    """Least ``(cost, audit, lines)`` by a forward search: the best of equal states, kept apart by length of the audit."""
    states = {("", 0): (0, "", ())}  # (initials reduced to a state, letters) -> cost, audit, lines

    def reduced(initials):
        return initials if initials in ("", "s") else "u" if initials[-1] == "u" else "a"

    def allowed(state, c):
        return {"": c in "su", "s": c == "u", "u": c == "a", "a": c == "u"}[state]

    def put(into, state, cost, audit, lines):
        key = state, len(audit)
        if key not in into or (cost, audit) < into[key][:2]:
            into[key] = cost, audit, lines

    def widened(states):
        out = dict(states)
        for _ in range(2):
            for (state, _), (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if allowed(state, role[0]):
                        put(out, role[0], cost + 2, audit + "I", (*lines, f"{role}:"))
        return out

    for (_, _, role, text), mark in zip(own, marks):
        after = {}
        for (state, _), (cost, audit, lines) in widened(states).items():
            put(after, state, cost + 3, audit + "D", lines)
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                if role[:1] and role[0] in "sua" and allowed(state, role[0]):
                    put(after, reduced(role[0]), cost + more, audit + "K", (*lines, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    if allowed(state, new[0]):
                        put(after, new[0], cost + 2 + more, audit + "R", (*lines, f"{new}:{text}"))
        states = after
    return min((v for (state, _), v in widened(states).items() if state in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    rows = [tuple(r) for r in rows]
    after = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(own)
        cost, audit, lines = best(own, marks)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [marks.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    got = CH.damage_report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_search_equals_every_edit():
    """The plain search itself, against all audits of up to three rows."""
    rng = random.Random(1)
    for _ in range(150):
        own = [(0, i, rng.choice(("system", "user", "assistant", "tool", "user")), rng.choice(("a.", "b", " ", "a."))) for i in range(rng.randint(0, 3))]
        marks = faults(own)
        found = []
        for n in range(2 * len(own) + 3):
            for audit in map("".join, itertools.product("DIKR", repeat=n)):
                if len(audit) - audit.count("I") != len(own):
                    continue
                for roles in itertools.product(("user", "assistant"), repeat=audit.count("I") + audit.count("R")):
                    cost, lines, at, free = 0, [], 0, list(roles)
                    for c in audit:
                        if c == "I":
                            lines.append((free.pop(0), ""))
                            cost += 2
                            continue
                        row, mark = own[at], marks[at]
                        at += 1
                        if c == "D":
                            cost += 3
                        elif mark in ("blank", "duplicate"):
                            break
                        else:
                            lines.append((free.pop(0) if c == "R" else row[2], row[3]))
                            cost += (2 if c == "R" else 0) + (mark == "truncated")
                    else:
                        if RIGHT.match("".join(r[0] for r, _ in lines)):
                            found.append((cost, audit, tuple(f"{r}:{t}" for r, t in lines)))
        assert min(found) == best(own, marks)


def test_letters_equal_the_search():
    rng = random.Random(2)
    names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    for _ in range(400):
        codes = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "048159") for _ in range(rng.randint(0, 14)))
        own = [(0, i, names["sua?"[int(c, 16) // 4]], str(i)) for i, c in enumerate(codes)]
        marks = [CH.FAULTS[int(c, 16) % 4] for c in codes]
        cost, audit, _ = best(own, marks)
        assert CH.letters(codes, None)[CH.START] == audit
        # the same through blocks of any size
        size = rng.randint(1, 5)
        parts, rests, rest = [codes[i : i + size] for i in range(0, len(codes), size)], [], None
        for part in reversed(parts):
            rests.append(rest)
            rest = CH.before(CH.cost_table(part), CH.END if rest is None else rest)
        assert (rest or CH.END)[CH.START] == cost
        state, whole = CH.START, ""
        for part, rest in zip(parts, reversed(rests)):
            way, row = CH.letters(part, rest)[state], 0
            for c in way:
                if c == "K":
                    state = CH.KEEPS[int(part[row], 16) // 4][state]
                elif c in "RI":
                    state = CH.DUE[state]
                row += c != "I"
            whole += way
        assert whole == audit


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "ü"))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 1)), role, rng.choice(("Hi.", "Hi", "no stop here", "Why?", " \n", "", "é!", "end. \t", "x" * 3000 + "."))))
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [
        (None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (1, None, None, None), (1, None, "user", "A."), (1, 3, "user", "A."), (1, 3, "user", "A."),
        (1, 3, "assistant", "B."), (1, 7, None, "B."), (2, 5, "assistant", "x"), (2, None, "system", "S."), (2, 9, "user", None), (3, 1, "system", "only"),
    ]
    check(spark, rows + [(c, t, "assistant", "tie") for c in range(10, 60) for t in (0, 0, 1)])
    check(spark, [])


def test_one_conversation_of_many_rows(spark):
    """Blocks of a long conversation, with many equal rows."""
    rng = random.Random(4)
    rows = [(7, i // 3, rng.choice(("user", "assistant")), rng.choice(("same.", f"own {i}.", f"own {i}"))) for i in range(1500)]
    rows += [(7, 2000, "user", "again and again.")] * 900 + [(i, 0, "user", "Hi.") for i in range(40)]
    edits = CH.repair(spark.createDataFrame(rows, SCHEMA))
    assert CH.BLOCK_BITS == 9
    own = sorted((r for r in rows if r[0] == 7), key=lambda r: r[1:])
    cost, audit, lines = best_long(own)
    got = sorted((r["place"], r["edit"], r["role"], r["text"]) for r in edits.where("conv_id = 7").collect())
    assert "".join(r[1] for r in got) == audit
    assert [f"{r[2]}:{r[3]}" for r in got if r[1] != "D"] == lines
    report = {r["conv_id"]: r for r in CH.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (report[7]["cost"], report[7]["audit"]) == (cost, audit) and report[7]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def best_long(own):
    """Suffix programme over plain strings: least ``(cost, audit)`` from each state."""
    marks = faults(own)
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    rest = {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    steps = []
    for (_, _, role, _), mark in zip(reversed(own), reversed(marks)):
        direct = {}
        for q in due:
            ways = [(rest[q][0] + 3, "D" + rest[q][1], q)]
            if mark not in ("blank", "duplicate"):
                c, more = role[0], mark == "truncated"
                if (c == "s" and q == "") or (c == "u" and q != "u") or (c == "a" and q == "u"):
                    ways.append((rest[c][0] + more, "K" + rest[c][1], c))
                ways.append((rest[due[q]][0] + 2 + more, "R" + rest[due[q]][1], due[q]))
            direct[q] = min(ways)[:2]
        new = dict(direct)
        for _ in range(2):
            new = {q: min(direct[q], (new[due[q]][0] + 2, "I" + new[due[q]][1])) for q in due}
        rest = new
        steps.append(None)
    cost, audit = rest[""]
    state, at, lines = "", 0, []
    full = {"u": "user", "a": "assistant"}
    for c in audit:
        if c == "I":
            state = due[state]
            lines.append(f"{full[state]}:")
            continue
        _, _, role, text = own[at]
        at += 1
        if c == "D":
            continue
        state = due[state] if c == "R" else role[0]
        lines.append(f"{full[state] if c == 'R' else role}:{text}")
    return cost, audit, lines


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op11_conversation_repair"](spark, sf).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], SCHEMA)
    odd = df.withColumns({c: F.lit("x") for c in ("pos", "block", "code", "codes", "kind", "copy", "copies", "at", "rest", "ways", "first", "fault", "t_conv", "r_conv", "gaps")})
    assert [tuple(r) for r in CH.repair_report(odd).collect()] == [tuple(r) for r in CH.repair_report(df).collect()]
    assert CH.damage_report(odd).count() == 1
