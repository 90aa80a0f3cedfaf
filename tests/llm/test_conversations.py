import hashlib
import itertools
import random
import re
import zlib

from hirelake.llm.conversations import SuffixAutomaton, damage, repair_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, audit) over all edit sequences, by search over whole outputs; rows: (initial, fault)."""
    best = {(0, ""): (0, "")}  # (rows taken, initials so far): (cost, audit)
    found = None
    for i in range(len(rows) + 1):
        for _ in range(4):
            for (at, out), (cost, audit) in list(best.items()):
                if at == i:
                    for r in "ua":
                        if re.match(r"s?(ua)*u?\Z", out + r):
                            key, value = (i, out + r), (cost + 3, audit + "I")
                            if best.get(key, (10**9, "")) > value:
                                best[key] = value
        for (at, out), (cost, audit) in list(best.items()):
            if at != i:
                continue
            if i == len(rows):
                if GRAMMAR.match(out):
                    found = min(found or (cost, audit), (cost, audit))
                continue
            initial, fault = rows[i]
            ways = [(out, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(out + initial, cost + more, "K")] + [(out + r, cost + 3 + more, "R") for r in "ua"]
            for o, c, e in ways:
                if re.match(r"s?(ua)*u?\Z", o) and best.get((i + 1, o), (10**9, "")) > (c, audit + e):
                    best[i + 1, o] = (c, audit + e)
    return found


def brute(rows):
    out = {}
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        after = []
        for c, t, role, text in rows:
            if c == conv:
                fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
                if fault:
                    role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                    after += [(t is not None, t or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (1 + (fault == 3))
        after.sort(key=lambda r: r[:4])
        turns = {r[1] for r in after if r[0]}
        faults, seen = [], set()
        for _, _, role, _, text in after:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] or " " for r in after]  # an empty role is like any unknown one
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, i, state = [], 0, ""
        for e in audit:
            due = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(due + ":")
                state = due[0]
                continue
            role, text = after[i][2], after[i][4]
            i += 1
            if e != "D":
                role = role if e == "K" else due
                lines.append(f"{role}:{text}")
                state = role[0]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_every_short_signature_has_the_cheapest_edits():
    letters = {"D": ("x", "blank"), **{k: (k, "") for k in "suax"}, **{k.upper(): (k, "truncated") for k in "suax"}}
    words = ["".join(w) for n in range(5) for w in itertools.product(letters, repeat=n)]
    words = sorted(random.Random(1).sample(words, 900) + ["", "s", "S"], key=lambda w: w[::-1])
    automaton = SuffixAutomaton()
    for word in words:
        assert automaton.solve(word) == cheapest([letters[c] for c in word]), word
    assert automaton.made < sum(map(len, words))  # common ends are solved once


def test_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["Hello.", "Fine!  ", "No end", "", " \t\n", "What?\x0b", "Hello.", "a\nb.", "é", "\xa0", None]
    rows = [(c, rng.choice([*range(12), None]) if c % 7 == 0 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s"]), rng.choice(texts)) for c in range(120) for t in range(rng.choice([1, 2, 4, 7]))]
    rows += [(None, 1, "user", "x."), (None, None, "user", "x."), (500, 2**62, "user", "y."), (500, -(2**62), "user", "y."), *[(501, 3, "user", "z.")] * 5]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "conv_id long, turn long, role string, text string, cost int, of string")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair_conversations(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], (k, [r for r in rows if r[0] == k])


def test_a_long_conversation_and_none(spark):
    rows = [(1, t, "ua"[t % 2] == "u" and "user" or "assistant", f"word {t}." if t % 5 else "cut") for t in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair_conversations(df).first()
    dropped = [t for t in range(30_000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    assert found.gaps == len(dropped) and len(found.audit) > 25_000 and found.cost > 0
    assert repair_conversations(df.limit(0)).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "a.b!") for c in range(5) for t in range(40)], "conv_id long, turn long, role string, text string")
    for r in damage(rows).collect():
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        assert (r.copies, r.role, r.text) == ({0: 0, 3: 2}.get(fault, 1), "user" if fault == 4 else "assistant", {1: "", 2: "ab"}.get(fault, "a.b!"))
