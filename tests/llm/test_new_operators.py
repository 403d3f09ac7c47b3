"""Conversation trie, spelling variants and chunk recipes against brute force, edge cases and their SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from bourseline.llm import lines, queries, recipes, spelling, turn_trie

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(frame):
    for name in ("g", "up", "n", "key", "word", "best", "recipe", "name", "my col", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.mark.parametrize("name", ["op11_turn_trie", "op12_spelling_variants", "op13_chunk_recipes"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{MIDDLE}/{table}.parquet')")
    frame = queries.QUERIES[name](spark, MIDDLE)
    result = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in frame.columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, frame.collect()), key=repr) == want


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        made[conv] = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
    nodes = {}
    for conv, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(conv)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(WORD, p[-1][1])) for p in below if p)
        ended = ",".join(str(c) for c in sorted(c for c in members if made[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids(path), sum(not kids(p) for p in below), saved, sha(ended)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [None, 1, 9])
def test_trie(spark, share):
    rows = [(c, t, "user" if t % 2 else "bot", f"hello  there {t if t < 3 else c % 7}\u0085x") for c in range(1, 90) for t in range(c % 5 + 1) if c != 40]
    rows += [(200, None, None, "first"), (200, 1, "user", None), (201, 1, "", ""), (None, 1, "user", "nobody"), (400, 1, "a", "b c"), (401, 1, "a", "b c"), (401, 1, "a", "b c")]
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(520, t, "user", f"long {t}") for t in range(280)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, turn_trie.shared_prefixes(clashing(frame), share).collect()), key=repr) == brute_trie(rows)
    assert turn_trie.shared_prefixes(frame.filter("false"), share).count() == 0


def test_a_trie_whose_first_turn_is_hot_is_cut(spark):
    rows = [(c, t, "user", "the same" if t < 2 else f"{t} {c // (4 - t)}") for c in range(300) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, turn_trie.shared_prefixes(frame, 20).collect()), key=repr) == brute_trie(rows)


def brute_spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        good = others and -others[0][0] >= 10 * n
        out[w] = [others[0][1] if good else None, w, n, len(others), -others[0][0] if good else None]
    for row in out.values():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return sorted(((w, *row) for w, row in out.items()), key=repr)


def test_spelling(spark):
    rows = [(1, "Station " * 40 + "stazion stazion stattion stattion statin statio statio"), (2, "ÉTOILES étoiles ÉTOILES " * 12 + "Étoilesx étoilesx ÉTOILE ÉTOILE"), (3, None), (3, ""), (None, "without number without number"), (1, "repeated repeated repeatet repeatet"), (1, "repeated repeated repeatet repeatet"), (4, "x*y 123 aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa aaaaaab aaaaaab"), (5, "abcdefg " * 200 + "abcdefh " * 20 + "abcdxfh " * 2 + "a" * 3000 + " " + "a" * 3000)]
    rows += [(100 + i, "Running through planted spellings everywhere without mercy ") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_forms(clashing(frame))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_spelling(rows)
    assert "abcdefg" in {r["root"] for r in got.filter("word = 'abcdxfh'").collect()}
    assert spelling.spelling_forms(frame.filter("false")).count() == 0


@pytest.mark.parametrize("size", [16, 1, 0])
def test_recipes(spark, size):
    """A name of one byte, or of none, makes different chunks share names: results stay the same."""
    long = " ".join(str(i * i) for i in range(60_000))
    rows = [(1, long), (2, long), (3, long[:-1]), (4, "x" + long), (5, None), (6, ""), (7, "a"), (8, "b"), (9, "a"), (9, "a"), (10, "a "), (11, "a"), (None, "a"), (None, "alone"), (12, "é"), (13, "é"), (7, "again")]
    rows += [(100 + i, "hot text") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    members = {}
    for doc_id, text in rows:
        members.setdefault(text or "", []).append(doc_id)
    want = set()
    for doc_id, text in rows:
        group = members[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        want.add((doc_id, keep, len(group), doc_id == keep, sha(text or "")))
    got = [tuple(r) for r in recipes.exact_groups(clashing(frame), size).collect()]
    assert len(got) == len(want) and set(got) == want
    assert recipes.exact_groups(frame.filter("false"), size).count() == 0


def test_kept_rows_of_equal_texts(spark):
    frame = clashing(spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b")], "doc_id long, text string"))
    out = recipes.without_copies(frame)
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4, 5]


def test_chunks_survive_an_insertion(spark):
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000))
    frame = spark.createDataFrame([(1, text), (2, "new beginning " + text)], "doc_id long, text string")
    one, two = (r["recipe"] for r in recipes.recipes(frame).orderBy("doc_id").collect())
    names = [{bytes(x[i : i + 16]) for i in range(0, len(x), 16)} for x in (one, two)]
    assert len(names[0] & names[1]) >= 0.9 * len(names[0])


def test_lines_keep_columns_of_any_name(spark):
    frame = clashing(spark.createDataFrame([(1, "one line of text here\nanother line of text"), (2, "one line of text here")], "doc_id long, text string")).withColumn("removed_lines__", F.lit(1))
    out = lines.without_repeats(frame)
    assert out.columns == [*frame.columns, "n_lines_", "n_removed_", "kept_sha256_"]
    assert {r["removed_lines__"] for r in out.collect()} == {1}
