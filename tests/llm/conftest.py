"""Small tables with everything that a corpus may hold."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [f"w{i}" for i in range(300)] + ["Straße", "été", "你好", "naïve"]


def messy_documents():
    """(doc_id, text, source): nulls, blanks, copies, near copies, shared passages, long texts."""
    rng = random.Random(5)

    def some(n):
        return [rng.choice(WORDS) for _ in range(n)]

    passage, leak = some(60), "the quick brown fox jumps over the lazy dog and runs far away".split()
    rows = [
        (10, None, "a"), (11, "", "a"), (12, " \t\n\x0b\x0c\r ", None), (13, "one", "b"),
        (14, "two words", "b"), (15, "four words are here", None), (16, " one two\u0085", "c"),
        (17, "x" * 50_000, "c"),
    ]
    base = some(200)
    rows += [(20 + i, " ".join(base), "a") for i in range(40)]
    rows += [(70 + i, ("  " if i % 2 else "\n").join(base) + " " * i, "hot") for i in range(5)]
    for i in range(30):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = f"new{i}"
        rows.append((100 + i, " ".join(near), "hot"))
    for i in range(60):
        text = some(rng.randrange(1, 80)) + (passage if i % 2 else []) + some(rng.randrange(1, 20))
        if i % 7 == 0:
            text += [w.upper() for w in leak] + some(5)
        rows.append((200 + i, rng.choice([" ", "\n", " , "]).join(text), rng.choice(["hot", "hot", "é", "Z", None])))
    rows.append((400, " ".join(some(30_000)), "long"))
    rng.shuffle(rows)
    return rows


BENCHMARK = [
    (1, "The quick brown fox, jumps over the lazy dog and RUNS far away!"),
    (2, "two words"), (3, None), (4, ""), (5, "?!"), (6, "jumps over the lazy dog and runs far away"),
    (10, "The quick brown fox, jumps over the lazy dog and RUNS far away!"),
]
PAGE = "<html><head><title>t</title></head><body><article><p>{}</p></article></body></html>"
PAGES = [
    (3, "http://a/1", PAGE.format("hello &amp; goodbye é 你好 " * 20)),
    (1, None, PAGE.format("hello &amp; goodbye é 你好 " * 20)),
    (2, "http://a/2 \r\nWARC-Type: x", PAGE.format("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")),
    (4, "http://a/4", None), (5, "http://a/5", ""), (6, "", " \x1f\u008b\x08 "),
    (7, "http://a/7", PAGE.format("long " * 200_000)),
] + [(100 + i, f"http://b/{i}", PAGE.format("copy " * 30)) for i in range(50)]


def messy_conversations():
    """(conv_id, turn, role, text): shared beginnings, copies, missing numbers, ids, roles and texts."""
    rng = random.Random(9)
    says = ["hello there", "", None, "yes", "no", " two\u0085 words ", "你好 world"]
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (-7, 1, "user", "minus"), (2**62, 1, None, "far")]
    for conv in [*range(45), 60, 73, 90, *range(200, 230)]:
        if conv >= 200:
            rows += [(conv, i, "user", f"copy {i}") for i in range(9)]
            continue
        for i in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", None])
            rows.append((conv, rng.choice([i, i, None]), role, rng.choice(says)))
    rows += rows[10:14] + [(99, i, "user", "long " * 3000) for i in range(12)]
    rng.shuffle(rows)
    return rows


def write(folder, name, columns, rows):
    table = pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(columns)})
    pq.write_table(table, f"{folder}/{name}.parquet", row_group_size=50)


@pytest.fixture(scope="session")
def messy(tmp_path_factory):
    """A folder with documents, benchmark, pages and labels; documents have columns whose names
    the operators use inside."""
    folder = tmp_path_factory.mktemp("messy")
    extra = [c for c in ("id", "n", "row", "digest", "size", "kept", "mark", "source_size", "class_id", "file", "lang", "n_chars")]
    columns = [("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]
    columns += [(c, pa.string()) for c in extra]
    docs = [(*row, *[f"{c}{row[0]}" for c in extra]) for row in messy_documents()]
    write(folder, "documents", columns, docs)
    write(folder, "benchmark", [("item_id", pa.int64()), ("text", pa.string())], BENCHMARK)
    pages = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]
    write(folder, "pages", [*pages, ("digest", pa.string()), ("page", pa.string())], [(*p, "d", "p") for p in PAGES])
    labels = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
    turns = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    inner = [(c, pa.string()) for c in ("slot", "n", "token", "key", "depth", "base", "h", "line")]
    write(folder, "conversations", turns + inner, [(*r, *["x"] * len(inner)) for r in messy_conversations()])
    write(folder, "labels", labels, [(r[0], int(i % 5 > 0), int(i % 9 == 0)) for i, r in enumerate(docs)] + [(10, None, None), (99999, 1, 1)])
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    docs = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    write(folder, "documents", docs, [])
    write(folder, "benchmark", [("item_id", pa.int64()), ("text", pa.string())], [])
    write(folder, "pages", [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())], [])
    write(folder, "labels", [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())], [])
    write(folder, "conversations", [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())], [])
    return str(folder)
