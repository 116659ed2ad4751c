"""Conversation repair against enumeration, and its parts over many pieces."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from larder.llm import repair
from larder.llm.common import ship

FORM = re.compile(r"(s?(ua)+)?")


def told(rows):
    """kind of each turn, as the contract tells it."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(repair.BLANKS)
        forced = not bare or (role, text) in seen
        seen.add((role, text))
        out.append((forced, bool(bare) and bare[-1] not in ".!?"))
    return out


def enumerated(rows):
    """Cheapest repair of a few turns: every choice of edits."""
    faults, best = told(rows), None
    for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, kept = 0, "", []
            for k, (role, text) in enumerate(rows):
                for x in inserts[k]:
                    cost, audit, kept = cost + 2, audit + "I", [*kept, ({"u": "user", "a": "assistant"}[x], "")]
                e, (forced, cut_off) = edits[k], faults[k]
                if e == "D":
                    cost, audit = cost + 3, audit + "D"
                    continue
                if forced:
                    break
                cost += cut_off + (0 if e == "K" else 2)
                audit += "K" if e == "K" else "R"
                kept = [*kept, (role if e == "K" else {"u": "user", "a": "assistant"}[e], text)]
            else:
                for x in inserts[-1]:
                    cost, audit, kept = cost + 2, audit + "I", [*kept, ({"u": "user", "a": "assistant"}[x], "")]
                if FORM.fullmatch("".join(r[:1] or "?" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, kept
    return best


def stepwise(rows):
    """Cheapest repair of any number of turns: least (cost, audit) of every state, turn by turn."""
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (c, a, kept) in list(best.items()):
                q = repair.NEXT[s]
                best[q] = min(best.get(q, (1 << 40, "", ())), (c + 2, a + "I", (*kept, f"{repair.ROLES[s]}:")))
        return best

    for (role, text), (forced, cut_off) in zip(rows, told(rows), strict=True):
        after = {}
        for s, (c, a, kept) in inserted(best).items():
            ways = [(s, c + 3, a + "D", kept)]
            if not forced:
                if role[:1] in repair.KEEPS[s]:
                    ways.append((repair.KEEPS[s][role[:1]], c + cut_off, a + "K", (*kept, f"{role}:{text}")))
                ways.append((repair.NEXT[s], c + cut_off + 2, a + "R", (*kept, f"{repair.ROLES[s]}:{text}")))
            for q, *way in ways:
                after[q] = min(after.get(q, (1 << 40, "", ())), tuple(way))
        best = after
    return min(way for s, way in inserted(best).items() if s in (0, 3))


def expected(rows):
    """All result columns of a conversation's rows (turn, role, text) after damage, in order."""
    pairs = [(r, t) for _, r, t in rows]
    turns = sorted({t for t, _, _ in rows if t is not None})
    blank = duplicate = truncated = 0
    seen = set()
    for role, text in pairs:
        bare = text.strip(repair.BLANKS)
        if not bare:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif bare[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, kept = stepwise(pairs)
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def whole(table):
    """Every conversation of (conv, turn, role, text) by brute force."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm:
            rows += [(turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)] * (2 if harm == 3 else 1)
    return {c: expected(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))) for c, r in out.items()}


def of_spark(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made_rows(rng, conv, n):
    texts = ["Yes.", "No!", "cut off", "  ", "What? ", "Yes.", "\t", "longer text here.", "é", "ok?\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(conv, rng.choice([k, k, k, k, None, k // 2]), rng.choice(roles), rng.choice([*texts, f"text {rng.randrange(10**6)}.", None])) for k in range(n)]


def test_few_turns_against_every_choice():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(r or " ", t or " ") for _, _, r, t in made_rows(rng, 0, rng.randrange(1, 4))]
        cost, audit, kept = enumerated(rows)
        assert stepwise(rows)[:2] == (cost, audit)
        assert list(stepwise(rows)[2]) == [f"{r}:{t}" for r, t in kept]


def test_divide_and_conquer_against_stepwise():
    rng = random.Random(4)
    for n in [*range(1, 20), 60, 200]:
        for _ in range(10):
            rows = [(r or " ", t or " ") for _, _, r, t in made_rows(rng, 0, n)]
            kinds = [repair.kind_of(r[:1], f, c) for (r, _), (f, c) in zip(rows, told(rows), strict=True)]
            turns = repair.Turns(kinds)
            last = repair.last_state(turns.forward(0, 0, n))
            assert "".join(repair.edits(kinds, [1] * n, 0, last)) + repair.TAIL[last] == stepwise(rows)[1]
            # the same through the tables of pieces
            cuts = sorted({0, n, *(rng.randrange(n) for _ in range(3))})
            spans = list(zip(cuts, cuts[1:], strict=False))
            items = repair.Pieces([repair.piece_table(repair.Turns(kinds[a:b])) for a, b in spans])
            last = repair.last_state(items.forward(0, 0, len(items)))
            at = repair.crossings(items, 0, last)
            letters = [x for k, (a, b) in enumerate(spans) for x in repair.edits(kinds[a:b], [1] * (b - a), at[k], at[k + 1])]
            assert "".join(letters) + repair.TAIL[last] == stepwise(rows)[1]


@pytest.mark.parametrize("piece", [4096, 7])
def test_conversations_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    ship(spark)
    rng = random.Random(5)
    table = [x for conv in [None, *range(60)] for x in made_rows(rng, conv, rng.randrange(1, 12))]
    table += made_rows(rng, 1000, 1500)  # a third of all rows and more
    table += [(2000, 5, "user", "the same.")] * 300 + [(2000, 6, "user", "x" * 300_000 + "."), (2000, 7, "", "")]
    rng.shuffle(table)
    df = spark.createDataFrame([(*x, "c") for x in table], "conv_id long, turn long, role string, text string, same string").repartition(5)
    assert of_spark(repair.repaired_conversations(df)) == whole(table)


def test_an_empty_table_and_a_conversation_without_turns(spark):
    ship(spark)
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repaired_conversations(spark.createDataFrame([], schema)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    out = repair.repaired_conversations(spark.createDataFrame([(1, gone, "user", "a.")], schema)).collect()
    assert [tuple(x) for x in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
