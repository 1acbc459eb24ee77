"""Repair and prefix trie against their definitions, on small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from semforge.llm import prefix_trie, repair

ROWS = "conv_id long, turn long, role string, text string"


def rows_of(seed, convs, most=6, roles=("system", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "cut off", "", " \t", "One.", "a?\n", "Ünï 語。", None, "x" * 5000 + "."]
    out = []
    for conv in convs:
        for turn in range(rng.randrange(most)):
            out.append((conv, rng.choice([turn, turn, turn, None, turn + 1]), rng.choice(roles), rng.choice(texts)))
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def cheapest(rows):
    """All edit strings by brute force: (cost, audit, roles and texts)."""
    best = None
    limit = 4 * len(rows) + 1
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            # Between equal audits the roles follow from the grammar.
            audit, cost = "", 3 * sum(inserts)
            options = [[]]
            for k in range(len(rows) + 1):
                audit += "I" * inserts[k]
                for _ in range(inserts[k]):
                    options = [[*o, (r, "")] for o in options for r in ("user", "assistant")]
                if k < len(rows):
                    (_, _, role, text), fault = rows[k][:4], rows[k][4]
                    audit += edits[k]
                    if edits[k] == "D":
                        cost += 4
                        continue
                    if fault in ("blank", "duplicate"):
                        cost = limit
                        break
                    cost += (3 if edits[k] == "R" else 0) + (3 if fault == "truncated" else 0)
                    options = [[*o, (r, text)] for o in options for r in (("user", "assistant") if edits[k] == "R" else (role,) if role else ())]
            if cost >= limit or (best is not None and (cost, audit) >= best[:2]):
                continue
            for o in options:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in o)):
                    best = (cost, audit, o)
                    break
    return best


def expected(conv, rows):
    blanks = " \t\n\x0b\f\r"
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, judged = set(), []
    for c, turn, role, text in order:
        bare = text.rstrip(blanks)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((c, turn, role, text, fault))
    turns = [r[1] for r in judged if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = {f: sum(r[4] == f for r in judged) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
    cost, audit, kept = cheapest(judged) if judged else (0, "", [])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


@pytest.mark.parametrize("segment", [2, 1024])
def test_repair(spark, segment):
    rows = [*rows_of(5, [*range(40), None, -7], 5), (900, 1, "user", "Hi."), *[(901, k, "assistant", "Same.") for k in range(4)], (902, None, None, None)]
    rows += [(903, k, r, f"{k}.") for k, r in enumerate(("user", "user", "system", "user"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS + ", audit string, conv long")
    got = sorted((tuple(r) for r in repair.repair_conversations(df, segment).collect()), key=str)
    hurt = list(damage(rows))
    want = sorted((expected(c, [r for r in hurt if r[0] == c]) for c in {r[0] for r in rows}), key=str)
    assert got == want
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_long_conversation_in_segments(spark):
    """Any cut into segments gives the same repair."""
    rng = random.Random(2)
    rows = [(0, k, rng.choice(["user", "assistant", "tool", "system"]), rng.choice([f"{k}.", f"{k}", "again."])) for k in range(300)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    found = {tuple(repair.repairs(df, n).first()) for n in (1, 7, 100, 1024)}
    assert len(found) == 1 and next(iter(found))[6] > 0


def test_grammar_is_reached_from_everything():
    for symbols in itertools.product("suaoSUAOx", repeat=3):
        cost, audit = min((w[0] + e[0], w[1] + e[1]) for w, e in zip([c[0] for c in repair._segment("".join(symbols))], repair._at_end()))
        assert cost < 20 and sum(x != "I" for x in audit) == 3


def slow_trie(rows):
    own = {}
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for top, members in nodes.items():
        sub = [n for n in nodes if n[: len(top)] == top]
        kids = [n for n in nodes if len(n) == len(top) + 1 and n[: len(top)] == top]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in sub)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in sub if n)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(top))
        out.append((min(members), len(top), min(nodes[top[:-1]]) if top else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie(spark):
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "語語"])) for c in [*range(0, 45), *range(100, 118), *range(301, 309)] for k in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(7, None, "user", "early"), (7, 2, "user", "a"), (7, 2, "user", "a"), (None, 1, "user", "no conversation"), *[(500, k, "user", f"{k % 3}") for k in range(70)], *[(501, k, "user", f"{k % 3}") for k in range(70)]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", depth int, node string")
    got = sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)
    assert got == slow_trie(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    turnless = spark.createDataFrame([(101, 0, "user", "x")], ROWS)
    assert sorted((tuple(r) for r in prefix_trie.trie(turnless).collect()), key=str) == slow_trie([(101, 0, "user", "x")])


def test_sums_over_runs(spark, monkeypatch):
    """Runs of depths of any size give the same sums."""
    rows = [(c, k, "user", "same" if k < 20 else f"{c}-{k}") for c in (200, 300, 400) for k in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == slow_trie(rows)
