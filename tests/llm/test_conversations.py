"""Conversation repair and the prefix trie against brute force, in several partitionings and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cytoloom.llm import prefix_trie as T
from cytoloom.llm.conversation_repair import damage, faults, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every way to edit every row and to insert up to two turns at every place."""
    fault = fault_of(rows)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    choices = []
    for (_, _, role, text), f in zip(rows, fault, strict=True):
        c = [("D", 2, None)]
        if f not in ("blank", "duplicate"):
            more = 5 * (f == "truncated")
            c += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(c)
    for edits in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, turns = "", 0, []
            for i in range(len(rows) + 1):
                audit += "I" * len(put[i])
                cost += 5 * len(put[i])
                turns += [(r, "") for r in put[i]]
                if i < len(rows):
                    audit += edits[i][0]
                    cost += edits[i][1]
                    turns += [edits[i][2]] if edits[i][2] else []
            initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in turns)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns)))
    return best


def brute_row(rows):
    rows = ordered(rows)
    fault = fault_of(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *brute_repair(rows))


def sample(seed, convs, most):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Assistant"], ["Yes.", "No?", "cut off", "", "  \n", None, "x!\t", "Yes.", "längere Zeile"]
    out = []
    for c in convs:
        for t in range(rnd.randint(1, most)):
            out.append((c, rnd.choice([t, t, t, t + rnd.randint(0, 5), None]), rnd.choice(roles[:3] if rnd.random() < 0.7 else roles), rnd.choice(texts)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repair_against_brute_force(spark, parts):
    rows = sample(7, [*range(40), None], 4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(damage(spark.createDataFrame(rows, SCHEMA).repartition(parts))).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        mine = damaged([r for r in rows if r[0] == c])
        assert got[c] == (brute_row(mine) if mine else (0, 0, 0, 0, 0, 0, "", sha(""))), (c, ordered(mine))


def test_repaired_turns_have_the_hash(spark):
    rows = damage(spark.createDataFrame(sample(3, range(30), 9), SCHEMA))
    done = repair(rows).cache()
    turns = repaired_turns(rows, done).orderBy("conv_id", "at").collect()
    for r in done.collect():
        own = [t for t in turns if t["conv_id"] == r["conv_id"]]
        assert sha("\n".join(f"{t['role']}:{t['text']}" for t in own)) == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in own))


def test_long_conversation_and_one_shuffle(spark):
    """20,000 turns of one user: every second one becomes an assistant's; time is linear and audits do not share beginnings."""
    rows = [(1, t, "user", f"Line {t}.") for t in range(20_001)] + [(2, 1, "user", "Hi." * 1_000_000), (2, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "false AS gone", "0 AS copy")
    got = {r["conv_id"]: r for r in repair(df).collect()}
    assert got[1]["cost"] == 10_002 and got[1]["audit"] == "D" + "KR" * 10_000
    assert (got[2]["cost"], got[2]["audit"]) == (0, "KK")
    assert faults(df)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_repair_odd_tables(spark):
    assert repair(damage(spark.createDataFrame([], SCHEMA))).count() == 0
    df = spark.createDataFrame([(1, 2**63 - 1, "user", "Yes.", 5), (1, -(2**63), "assistant", "No.", 6)], SCHEMA + ", fault int").selectExpr("*", "1 AS seen", "2 AS h")
    assert repair(damage(df)).count() == 1  # columns of the same names as inner ones


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    for c, own in convs.items():
        convs[c] = [(r, x) for _, r, x in sorted(own, key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.md5(y[2].encode()).hexdigest()))]
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (c % 100 if c >= 0 else -(-c % 100))
        new[c] = convs.get(lead, [])[:h] + own[h:]
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, who in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        ends = sorted(c for c in who if len(new[c]) == len(key))
        out.append((min(who), len(key), min(nodes[key[:-1]]) if key else None, len(who), sum(len(k) == len(key) + 1 for k in below), len(leaf), sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), sha(",".join(map(str, ends)))))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("parts", [1, 5])
def test_trie_against_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(T, "LARGEST", 4)  # some parts are broadcast, some are joined
    monkeypatch.setattr(T, "_RUN", 3)
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 14), *range(100, 109), 305, -7, -100, None]:
        same = rnd.random() < 0.5
        for t in range(rnd.randint(1, 8)):
            rows.append((c, None if t == 3 else t, rnd.choice(["user", "assistant", None]) if not same else "user", rnd.choice(["a", "bb", None, ""]) if not same else "same"))
    rows += [r for r in rows if r[0] == 5]
    got = T.prefix_trie(*T.rebuilt(T.numbered(spark.createDataFrame(rows, SCHEMA).repartition(parts))))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == brute_trie(rows)


def test_trie_odd_tables(spark):
    def trie(rows, more=""):
        return sorted(map(tuple, T.prefix_trie(*T.rebuilt(T.numbered(spark.createDataFrame(rows, SCHEMA + more)))).collect()), key=lambda r: r[:2])

    assert trie([]) == [] and trie([(None, 1, "user", "x")]) == []
    one = [(1, 1, "user", "x")] * 8
    assert trie([(*r, 1, 2) for r in one], ", pos int, key int") == brute_trie(one)
    long = [(7, t, "user", str(t)) for t in range(300)] + [(8, t, "user", str(t)) for t in range(9)] + [(7, 300, "user", "x" * 2_000_000)]
    assert trie(long) == brute_trie(long)
