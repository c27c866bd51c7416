"""Conversation structure repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from rankframe.llm import structure_repair
from rankframe.llm.queries import QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string, cost int, n string"
ALLOWED = re.compile(r"(s?(ua)+)?")


def cheapest_by_hand(rows):
    """rows: (initial, may stay, extra cost). Best (cost, audit) of every prefix of rows and end of the roles so far."""
    best = {(0, ""): (0, "")}

    def better(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value
            return True

    def begins(roles):
        return any(ALLOWED.fullmatch(roles + more) for more in ("", "a", "ua"))

    for i in range(len(rows) + 1):
        grown = True
        while grown:
            grown = False
            for (at, roles), (cost, audit) in list(best.items()):
                for more in "ua":
                    if at == i and begins(roles + more) and len(roles) < 2 * len(rows) + 4:
                        grown |= bool(better(best, (i, shortened(roles + more)), (cost + 3, audit + "I")))
        if i == len(rows):
            break
        initial, stays, extra = rows[i]
        for (at, roles), (cost, audit) in list(best.items()):
            if at != i:
                continue
            better(best, (i + 1, roles), (cost + 4, audit + "D"))
            if stays and begins(roles + initial) and initial:
                better(best, (i + 1, shortened(roles + initial)), (cost + extra, audit + "K"))
            for more in "ua":
                if stays and begins(roles + more):
                    better(best, (i + 1, shortened(roles + more)), (cost + 3 + extra, audit + "R"))
    return min(v for (at, roles), v in best.items() if at == len(rows) and ALLOWED.fullmatch(roles))


def shortened(roles):
    """Whole pairs behind the first say nothing more about what may follow."""
    head = roles[:1] if roles.startswith("s") else ""
    rest = roles[len(head) :]
    return head + ("ua" if len(rest) >= 2 else "") + ("u" if len(rest) % 2 else "") if len(rest) > 2 else roles


def test_search_on_all_short_codes():
    for n in range(5):
        for code in itertools.product("suxASU0", repeat=n):
            rows = [("" if c == "0" else c.lower(), c != "0", 3 * c.isupper()) for c in code]
            assert structure_repair.cheapest("".join(code)) == cheapest_by_hand(rows), code


def test_search_on_longer_codes():
    pick = random.Random(3)
    for _ in range(300):
        code = "".join(pick.choices(structure_repair.SOUND + structure_repair.CUT + structure_repair.DOOMED, k=pick.randint(5, 30)))
        rows = [(structure_repair.INITIALS[c], c not in "0123", 3 * (c in "SUAX")) for c in code]
        assert structure_repair.cheapest(code) == cheapest_by_hand(rows), code


def test_memory_and_time_of_a_very_long_conversation():
    assert structure_repair.cheapest("uaU" * 20_000)[0] == 20_000 * 4


def damaged_by_hand(rows):
    made = {}
    for conv, turn, role, text, *_ in rows:
        kept = made.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return made


def repaired_by_hand(told):
    rows = []
    for conv, said in told.items():
        said = sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in said if t is not None}
        faults, codes, seen = [], [], set()
        for _, role, text in said:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault not in ("blank", "duplicate"), 3 * (fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit = cheapest_by_hand(codes)
        out, i = [], 0
        for edit in audit:
            row = said[i] if edit != "I" else None
            i += edit != "I"
            if edit == "K":
                out.append((row[1], row[2]))
            elif edit != "D":
                out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", row[2] if row else ""))
        assert ALLOWED.fullmatch("".join(r[:1] for r, _ in out))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        rows.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(rows, key=repr)


def odd_rows(seed, n):
    pick = random.Random(seed)
    texts = ["Yes.", "no", "", None, " \t", "a\nb!", "Why? ", "Yes.", "é…", "x" * 30_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(pick.randint(1, 9)):
            turn = pick.choice([turn, turn, turn, turn + 2, None])
            rows.append((conv, turn, pick.choice(roles[:2] * 3 + roles), pick.choice(texts), 1, "n"))
    return rows


def test_damage_and_repair(spark):
    rows = odd_rows(1, 150)
    got = []
    for r in structure_repair.repair(damaged(spark.createDataFrame(rows, SCHEMA)), F.col("there")).collect():
        said = "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"])
        got.append((*r[:-1], hashlib.sha256(said.encode()).hexdigest()))
    want = repaired_by_hand(damaged_by_hand(rows))
    assert sorted(got, key=repr) == want
    assert any(not r[7] for r in want) and any("I" in r[7] and "K" in r[7] for r in want)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_structure_repair"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == repaired_by_hand(damaged_by_hand(rows))


def test_whole_tables_without_damage_and_extremes(spark):
    df = spark.createDataFrame([(1, -(2**63), "user", "Hi.", 0, ""), (1, 2**63 - 1, "assistant", "Yo.", 0, "")], SCHEMA)
    got = structure_repair.repair(df).collect()[0]
    assert (got["gaps"], got["cost"], got["audit"], [tuple(r) for r in got["repaired"]]) == (None, 0, "KK", [("user", "Hi."), ("assistant", "Yo.")])
    assert structure_repair.repair(df.limit(0)).count() == 0


def test_one_conversation_with_most_rows(spark):
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id"), F.when(F.col("id") % 1000 == 7, "").otherwise(".")).alias("text"),
    )
    got = structure_repair.repair(rows).collect()
    assert [(r["truncated"], r["cost"], r["audit"] == "K" * 30_000) for r in got] == [(30, 90, True)]
