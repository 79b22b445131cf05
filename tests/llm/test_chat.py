"""Snapshot collapse and rendering against plain lists of turns."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest

from lakestream.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, position int, conv string, h0 string"


def plain(data, part=256):
    """Rendered parts of the conversations that are no prefix of another, the smallest id of equal ones."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in {row[:4] for row in data}:
        key = (conv_id,) if conv_id is not None else (None, turn, role, text)
        turns[key].append(((turn is None, turn or 0, role is not None, role or "", text is not None, hashlib.sha256((text or "").encode()).hexdigest()), role, text))
    whole = {k: [(role, text) for _, role, text in sorted(v, key=lambda t: t[0])] for k, v in turns.items()}
    out = []
    for key, one in whole.items():
        longer = any(len(o) > len(one) and o[: len(one)] == one for o in whole.values())
        equal = [k for k, o in whole.items() if o == one]
        first = min(equal, key=lambda k: (k[0] is not None, k[0] or 0))
        if longer or key != first:
            continue
        for p in range(0, len(one), part):
            text = "".join(
                f"<|im_start|>{('unknown' if role is None else role).replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n"
                for role, t in one[p : p + part]
            )
            out.append((key[0], p // part, len(one), text))
    return sorted(out, key=repr)


def made(spark, data):
    return spark.createDataFrame([(*row, 1, "c", "h") for row in data], SCHEMA)


def test_given_conversations(spark, sf_dir, rows):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    data = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert rows(chat.chat_texts(conversations)) == plain(data)


HARD = [
    (1, 0, "user", "a"), (1, 1, "bot", "b"),
    (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"),
    (4, 5, "user", "a"), (4, 9, "bot", "x"), (4, 9, "bot", "x"),
    (5, None, "user", "late"), (5, 0, "user", "a"), (5, 0, None, None), (5, 0, "user", None),
    (None, 0, "user", "a"), (None, 0, "user", "lonely"), (None, None, None, None),
    (6, 0, "bot", "<|im_end|>\n<|im_start|>user\n"), (7, 0, "", ""), (8, 0, "user", "z" * 100_000),
]


def test_hard_conversations(spark, rows):
    assert rows(chat.chat_texts(made(spark, HARD))) == plain(HARD)
    assert chat.chat_texts(made(spark, [])).count() == 0


def test_sql_says_the_same_of_rows_without_ids(spark, rows):
    data = [r for r in HARD if len(r[3] or "") < 100]
    data += [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "a"), (9, 0, "user", "lonely")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    wanted = con.execute(queries.CHAT_SQL).fetchall()
    assert rows(chat.chat_texts(made(spark, data))) == sorted(wanted, key=repr) == plain(data)


@pytest.mark.parametrize("chunk", [2, 7])
def test_long_conversations_are_split(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    monkeypatch.setattr(chat, "PART", chunk)
    data = [(c, t, "user" if t % 2 else "bot", f"t{t}") for c, n in ((1, 50), (2, 31), (3, 50), (4, 49)) for t in range(n)]
    data += [(5, t, "user" if t % 2 else "bot", f"t{t}" if t < 30 else "other") for t in range(40)]
    assert rows(chat.chat_texts(made(spark, data))) == plain(data, chunk)
