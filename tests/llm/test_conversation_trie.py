"""Double arrays and the prefix trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tradewind.llm.conversation_trie import op13_conversation_trie, prefix_trie, rebuilt
from tradewind.llm.double_array import DoubleArray, dense


@pytest.mark.parametrize("symbols", [2, 6, 400])
def test_double_array_has_a_slot_for_each_prefix(symbols):
    rng = random.Random(symbols)
    for _ in range(40):
        given = {tuple(rng.randrange(symbols) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 200))}
        sequences = sorted(given)
        lengths = np.array([len(s) for s in sequences])
        flat = np.array([x for s in sequences for x in s], np.int64)
        item = np.repeat(np.arange(len(lengths)), lengths)
        depth = np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[item]
        codes = dense(flat, np.lexsort((item, depth)))
        trie = DoubleArray()
        slots = trie.add(codes, lengths).tolist()
        at, starts, slot_of = 0, np.cumsum(lengths) - lengths, {}
        for sequence, start in zip(sequences, starts.tolist(), strict=True):
            at = np.array([0])
            for i in range(len(sequence)):
                at = trie.step(at, codes[start + i : start + i + 1])
                assert slot_of.setdefault(sequence[: i + 1], int(at[0])) == int(at[0]) == slots[start + i]
        assert len(set(slot_of.values())) == len(slot_of) == int((trie.check[: trie.top] >= 0).sum())
        assert trie.top <= 4 * (len(slot_of) + symbols) + 2
        assert trie.step(np.array([0]), np.array([10**6]))[0] == -1


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + words.to_bytes(4, "big")
            own.setdefault(conv, []).append((turn is not None, turn or 0, token, role, text, words))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        paths[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members, saved, leaves = {}, {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(t[1:3] for t in path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
        leaves[node] = sum(leaves[k] for k in below) if below else 1
    length = {c: len(p) for c, p in paths.items()}
    return sorted(
        (min(m), len(node), str(min(members[node[:-1]]) if node else None), len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if length[c] == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(str(r[n]) if n == "parent_conv_id" else r[n] for n in names) for r in df.collect())


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("table", ["folder", "messy"])
def test_query_is_a_plain_trie(spark, table, request):
    path = request.getfixturevalue(table)
    assert got(op13_conversation_trie(spark, path)) == expected(rows_of(spark, path))


@pytest.mark.parametrize(("segment", "chunk"), [(1, 1), (2, 7), (3, 1000), (512, 4), (512, 40)])
def test_any_cut_gives_the_same(spark, messy, segment, chunk):
    turns, members = rebuilt(spark.read.parquet(f"{messy}/conversations.parquet"))
    assert got(prefix_trie(turns, members, segment, chunk)) == expected(rows_of(spark, messy))


def test_many_copies_and_a_turnless_conversation(spark):
    rows = [(c, t, "user", f"t{t} and more") for c in range(300, 700) for t in range(4)]
    # Of 41 and 43 only turns that they take from 40 could stay, and there is no 40.
    rows += [(c, 0, "user", "gone") for c in (41, 43, 46, 47, 50, 52, 55)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, members = rebuilt(given.repartition(6))
    result = got(prefix_trie(turns, members, chunk=6))
    assert result == expected(rows)
    root = next(r for r in result if r[1] == 0)
    assert root[3] == 407
