"""Conversation repair against a search through all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cadencia.llm import repair_turns as rt

SCHEMA = "conv_id long, turn long, role string, text string, cid string, block long, place long, same string, pos long"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters, repaired) over all edits; ``rows`` is (role, text, fault)."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def grow(found):
        more = set(found)
        for _ in range(3):
            more |= {(s2, c + 2, done + (("I", names[s2], ""),)) for s, c, done in more for s2 in [follows[s]]}
        return more

    now = {("", 0, ())}
    for role, text, fault in rows:
        after = set()
        for s, c, done in grow(now):
            after.add((s, c + 3, done + (("D", None, None),)))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if role[:1] == "s" and s == "":
                after.add(("s", c + late, done + (("K", role, text),)))
            if role[:1] == follows[s]:
                after.add((follows[s], c + late, done + (("K", role, text),)))
            after.add((follows[s], c + late + 2, done + (("R", names[follows[s]], text),)))
        least = defaultdict(lambda: 10**9)
        for s, c, _ in after:
            least[s] = min(least[s], c)
        # a path that is dearer than another one to the same state can't win; those dearer by one stay in, too
        now = {x for x in after if x[1] <= least[x[0]] + 1}
    done = [(c, "".join(e[0] for e in d), d) for s, c, d in grow(now) if re.fullmatch(r"(s?(ua)+)?", "".join(e[1][0] for e in d if e[0] != "D"))]
    return min(done, key=lambda x: x[:2])


def plain(rows):
    """What ``repaired`` should give, for rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    ids = set()
    for c, t, role, text in rows:
        ids.add(c)
        role, text = " " if role is None else role, " " if text is None else text
        roll = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if roll == 0:
            continue
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        convs[c] += [(t, "user" if roll == 4 else role, text)] * (2 if roll == 3 else 1)
    out = {}
    for c in ids:
        mine = sorted(convs[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}\0{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, edits = cheapest([(r, x, f) for (_, r, x), f in zip(mine, faults)])
        lines = "\n".join(f"{r}:{x}" for e, r, x in edits if e != "D")
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def made(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", "Done. \t", None, f"Turn {t}.", "é.\x0b", "\xa0"])
            rows.append((c, r.choice([t, t, t, t + 1, None]), role, text))
    return rows


def results(df):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in cols) for r in df.collect()}


def with_extra(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_search(spark, seed):
    rows = made(seed)
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Nobody."), (900, None, "user", "x."), (901, -5, "user", "A."), (901, 7, "assistant", "B.")]
    rows += [(902, 1, "user", "Same."), (902, 1, "user", "Same."), (902, 2, "assistant", "Same."), (903, 1, "user", "w. " * 50000), (903, 2, "assistant", "w " * 50000)]
    got, want = results(rt.repaired(with_extra(spark, rows))), plain(rows)
    assert got == want


def test_codes_of_all_kinds_against_search():
    r = random.Random(5)
    for _ in range(300):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), str(i), r.choice(["", "", "blank", "truncated"])) for i in range(r.randint(0, 6))]
        kinds = {"s": 0, "u": 1, "a": 2, "t": 3}
        codes = [(kinds[x[0][0]], {"": rt.FINE, "blank": rt.GONE, "truncated": rt.CUT}[x[2]]) for x in rows]
        ends = [(p[0] + 2 * n, p[1] + "I" * n) for p, n in zip(rt.summary(codes)[0], (0, 2, 1, 0)) if p]
        assert min(ends) == cheapest(rows)[:2]


def test_halves_chain_to_the_whole(monkeypatch):
    r = random.Random(6)
    rows = [(r.randint(0, 3), r.choice([0, 0, 1, 2])) for _ in range(90)]
    whole = rt.summary(rows)
    monkeypatch.setattr(rt, "SPAN", 5)
    assert rt.summary(rows) == whole


def test_conversation_of_many_blocks(spark):
    """The blocks of a long conversation give what one run over it gives."""
    r = random.Random(7)
    rows = [(1, t * 50, r.choice(["user", "assistant"]), r.choice([f"T{t}.", f"T{t}", ""])) for t in range(700)]
    found, lines = rt.repair(with_extra(spark, rows).select("conv_id", "turn", "role", "text"))
    row = found.collect()[0]
    codes = [(1 if x[2] == "user" else 2, rt.GONE if not x[3] else rt.FINE if x[3][-1] == "." else rt.CUT) for x in rows]
    ends = [(p[0] + 2 * n, p[1] + "I" * n) for p, n in zip(rt._short(tuple(codes))[0], (0, 2, 1, 0)) if p]
    assert (row["cost"], row.audit) == min(ends)
    roles = [x.role[0] for x in lines.orderBy("block", "pos").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles)) and len(roles) == sum(c != "D" for c in row.audit)
    assert row.gaps == 699 * 50 + 1 - 700


def test_nothing_left_and_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (dropped, None, None, None)]
    got = results(rt.repaired(with_extra(spark, rows)))
    assert got == plain(rows)
    one = [(dropped, 0, "user", "Hi.")]
    assert results(rt.repaired(with_extra(spark, one))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert rt.repaired(with_extra(spark, one).where("conv_id < 0")).collect() == []
