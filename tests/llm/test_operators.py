"""The training-data operators against brute force, on edge cases and on the smallest documents."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bourseline.llm import alignment, decontaminate, graph, html_text, langid, lines, media, near_dup, packing, pii, queries, substrings, token_store
from bourseline.llm.tokens import PieceEncoder, encoder, public_path

SMALL = "/root/testdata/sf0.001"
LONG = "thdore annt " * 30_000
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", 1.5),
    (2, None, "en", None),
    (3, "", None, 2.0),
    (4, "   \n\t ", "en", 0.0),
    (5, "The quick brown fox jumps over the lazy dog. " * 3, "en", 1.0),
    (5, "The quick brown fox jumps over the lazy dog. " * 3, "en", 1.0),
    (6, "12345 67890 !!!", "fr", 1.0),
    (7, LONG, "fr", 1.0),
    (None, "no id here", "en", 1.0),
    (8, "été à la plage 🙂 naïve\u0001x", "fr", 1.0),
]
#: ``score``, ``sim``, ``bucket``, ``start`` clash with names that operators use inside.
ODD_SCHEMA = "doc_id long, text string, lang string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    for name in ("sim", "bucket", "start", "label", "n_lines_", "u", "sigs"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame.cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_is_exact(texts, file, spaced):
    own = [*list(texts.values())[:60], "", " ", "a  b", "a \n b", "\x01 a", "IT'S 'tis DON'T", "é　z", "<|endoftext|> hi", "naïve 🙂 x🙂 12", " x ", "á e"]
    whole = Tokenizer.from_file(public_path(file))
    whole.encode_special_tokens = True
    enc = PieceEncoder(public_path(file), spaced, pieces=200, tokens=300)  # small caches, so that generations turn over
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(own, group=20_000)]
        assert got == [x.ids for x in whole.encode_batch(own, add_special_tokens=False)]


def packed(pieces, ids):
    seqs, parts = {}, {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, own in parts.items():
        data, at = ids[doc], 0
        for start, length, crc, n in sorted(own):
            assert (start, n) == (at, len(data) // 4)
            assert zlib.crc32(data[4 * start : 4 * (start + length)]) == crc
            at += length
        assert at == len(data) // 4
    used = [sum(n for _, n in s) for s in seqs.values()]
    return sum(0 if u & (u - 1) == 0 else 2048 - u for u in used) / sum(used)


def test_packing(docs, texts, odd, none):
    enc = PieceEncoder(public_path("byte_bpe_50k.json"), True)
    one = np.array([1], "<u4").tobytes()
    ids = {d: enc.encode([t])[0] + one for d, t in texts.items()}
    pieces = packing.pack_documents(docs).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    assert packed(pieces, ids) < 0.03
    assert packing.pack_documents(none).count() == 0
    got = packing.pack_documents(odd).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got}[2] == 1
    assert {r["doc_id"]: r["n"] for r in got}[5] % 2 == 0


def test_token_store(spark, docs, texts, odd, none, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path)
    got = token_store.read_digest(spark, path).orderBy("start").collect()
    enc = PieceEncoder(public_path("word_bpe_49k.json"), False)
    at = 0
    for r, doc in zip(got, sorted(texts), strict=True):
        data = enc.encode([texts[doc]])[0] + np.array([2], "<u4").tobytes()
        assert tuple(r) == (doc, at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    doc = sorted(texts)[3]
    assert token_store.read_document(spark, path, doc) == [np.frombuffer(enc.encode([texts[doc]])[0], "<u4").tolist() + [2]]
    for name, rows, n in (("odd", odd, len(ODD_ROWS)), ("none", none, 0)):
        token_store.write_store(rows, f"{path}-{name}")
        assert token_store.read_digest(spark, f"{path}-{name}").count() == n


def test_media_round_trip(spark, odd, none, tmp_path):
    for size in (0, 1, 63, 64, 175, 176, 16_384, 40_001):
        payload = bytes(i * 7 % 251 for i in range(size)) or bytes(64)
        stream, stamps, points = media.mux(payload)
        assert media.demux(stream) == (payload, stamps, points)
    damaged = bytearray(media.mux(bytes(4000))[0])
    damaged[188 * 4 + 3] ^= 5
    with pytest.raises(ValueError):
        media.demux(bytes(damaged))
    path = f"file://{tmp_path}/media"
    media.write_media(odd, path)
    got = {r["doc_id"]: r for r in media.media_digest(spark.read.parquet(path)).collect()}
    for doc, text, *_ in ODD_ROWS:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (got[doc]["n_bytes"], got[doc]["payload_bytes"], got[doc]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[doc]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.media_digest(media.to_media(none)).count() == 0


def plain_profile(text):
    counts = {}
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        s = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g.strip() and " " not in g[1:-1]:
                    counts[g] = counts.get(g, 0) + 1
    return counts


def test_language_counts_and_accuracy(spark, docs, odd, none):
    text = "Le été, LE eau 12 le"
    keys, counts = langid.ngram_counts(text)
    name = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    got = dict(zip(map(name, keys.tolist()), counts.tolist(), strict=True))
    want = plain_profile(text)
    # a space between words is one character: its n-grams of one space count once for both words
    assert {g: n for g, n in got.items() if " " not in g} == {g: n for g, n in want.items() if " " not in g}
    assert {g: n for g, n in got.items() if " " in g} == {g: n for g, n in want.items() if " " in g}
    profiles = langid.learn_profiles(docs)
    rows = langid.identify(docs, profiles).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    got = langid.identify(odd, profiles)
    assert got.columns.count("score") == 1
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(found[d] == ("und", 0.0) for d in (2, 3, 4, 6))
    assert all(0 <= s <= 1 for _, s in found.values())
    assert langid.identify(none, profiles).count() == 0
    assert langid.identify(odd, langid.learn_profiles(none)).filter("lang_pred <> 'und'").count() == 0


def plain_windows(rows, size=13):
    first = {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_words", [300, 1_000_000])
def test_windows(docs, odd, none, batch_words):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in substrings.removal_digest(docs, batch_words=batch_words).collect()), key=str) == plain_windows(rows)
    got = sorted((tuple(r) for r in substrings.removal_digest(odd, batch_words=batch_words).collect()), key=str)
    assert got == plain_windows([r[:2] for r in ODD_ROWS])
    assert substrings.removal_digest(none).count() == 0


def test_spans_agree_with_their_sources(docs, texts):
    spans = substrings.repeated_spans(docs, batch_words=3000).collect()
    assert spans
    for r in spans:
        own, source = texts[r["doc_id"]].split(), texts[r["source_doc"]].split()
        assert r["source_doc"] < r["doc_id"]
        assert own[r["start"] : r["start"] + r["n_words"]] == source[r["source_start"] : r["source_start"] + r["n_words"]]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ([int(x) for x in rng.integers(0, 3, rng.integers(0, 9))] for _ in range(2))
        d = plain_edits(a, b)
        for limit in range(6):
            assert alignment.edits_within(a, b, limit) == (d if d <= limit else None)
        assert lines.edits("".join(map(str, a)), "".join(map(str, b))) == d


def plain_links(rows, similarity=0.8):
    """All pairs of different texts whose words' edit similarity reaches the limit, by comparing every pair."""
    words = {d: t.lower().split() for d, t in rows.items()}
    names = sorted(rows, key=lambda d: len(words[d]))
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            limit = int((1 - similarity) * len(words[b]) + 1e-9)
            if len(words[b]) - len(words[a]) > limit:
                break
            if words[a] == words[b] or alignment.by_bits(words[a], words[b]) <= limit:
                out.append((min(a, b), max(a, b)))
    return out


def test_near_duplicates(docs, texts, odd, none):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    want = plain_links({d: t for d, t in texts.items() if len(t) < 20_000})
    assert sum(got[a] == got[b] for a, b in want) >= 0.9 * len(want)
    distinct = {(a, b) for a, b in want if texts[a] != texts[b]}
    assert sum(got[a] == got[b] for a, b in distinct) >= 0.9 * len(distinct)
    own = {d: d for d in got}  # classes of the links alone: no document is in a larger class than its links make
    for _ in range(20):
        for a, b in want:
            own[a] = own[b] = min(own[a], own[b])
    for d, c in got.items():
        if len(texts[d]) < 20_000:
            assert own[d] == own[c]
    found = near_dup.near_duplicates(odd).collect()
    assert len(found) == len(ODD_ROWS)
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert (classes[1], classes[5], classes[2], classes[3], classes[None]) == (1, 1, 2, 2, None)
    assert near_dup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(40, 41), (41, 41), (50, 50)], "u long, v long")
    assert {r["v"]: r["label"] for r in graph.components(edges).collect()} == {**dict.fromkeys(range(10, 31), 10), 40: 40, 41: 40}
    assert graph.components(edges.filter("false")).count() == 0


def test_lines(spark, odd, none):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    rows = [(1, f"{base}\nshort one\nLine Number 12 here"), (2, f"own words here\n{base.upper()}!\nline number 99 HERE\nshort one"), (3, f"{base} tau\n\nother text entirely different"), (4, None), (None, base), (2, f"own words here\n{base.upper()}!\nline number 99 HERE\nshort one")]
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] == rows[0][1]
    assert texts[2] == "own words here\nshort one"
    assert texts[4] is None
    assert texts[None] == base
    assert [r["n_removed_"] for r in got if r["doc_id"] == 2] == [2, 2]
    cut = lines.without_repeats(odd)
    assert cut.count() == len(ODD_ROWS)
    assert cut.columns.count("n_lines_") == 1
    assert lines.without_repeats(none).count() == 0


def test_simhash_candidates_are_complete():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 200, dtype=np.int64).view(np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    for number in (10, 1 << 26, 1 << 36):
        masks = lines.masks(number)
        assert all(any((int(a) ^ int(b)) & m == 0 for m in masks) for a, b in zip(base, near, strict=True))


def plain_edits_share(item, doc):
    row = [0] * (len(doc) + 1)
    for x in item:
        last = 0
        for j, y in enumerate(doc, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = ([int(x) for x in rng.integers(0, 4, rng.integers(1, 12))] for _ in range(2))
        bits = {x: sum(1 << i for i, y in enumerate(a) if x == y) for x in a}
        assert decontaminate.longest_common(bits, len(a), b) == plain_edits_share(a, b)


def test_leaks(spark, docs, texts, odd, none):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {(d, i) for d, t in texts.items() for i, b in items.items() if plain(b) in plain(t)}
    # a paraphrase: every ninth word of an item replaced, in the middle of another text
    item = min(i for i in items if len(items[i].split()) > 25)
    words = [("xyz" if k % 9 == 4 else w) for k, w in enumerate(items[item].split())]
    other = texts[max(texts)].split()[:60]
    extra = spark.createDataFrame([(999_999, " ".join(other[:30] + words + other[30:]))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs.select("doc_id", "text").unionByName(extra), bench).collect()}
    assert want <= got
    assert (999_999, item) in got
    assert got - want <= {(999_999, item)}
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.filter("false")).count() == 0
    assert decontaminate.decontaminated(odd, bench).count() == len(ODD_ROWS)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PII_ROWS = [
    (1, "a.b@c.de@f.gh x+y@z.w-q_r@s.tu mail me@x.y."),
    (2, "4111 1111 1111 1111 and 4111-1111-1111-1112 or 🙂 4111111111111111"),
    (3, "1.2.3.4.5 999.1.1.1 0255.0.0.01 1..2.3.4 8.8.8.8"),
    (4, "+1 (555) 123-4567 +12 +1234567890123456 ++1.555.123.4567"),
    (5, None),
    (6, ""),
    (7, "1" * 30_000 + " " + "a" * 30_000 + "@"),
    (8, "\u0001me@x.yz\u0001 \u0002"),
    (9, "reach jodoe[at]mailer[dot]com or (212) 555-0187 tel, ip 10[.]20[.]30[.]40"),
    (10, "on 2024-01-02 paid 12345678901234567890 for 3.14159265358979 items"),
]


def test_pii(spark, docs, texts, none):
    model, limits = pii.train(spark)
    rows = spark.createDataFrame(PII_ROWS, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(rows.unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000)), model, limits)).collect()}
    for doc, text in [*PII_ROWS, *((d + 1000, t) for d, t in texts.items())]:
        base = plain_spans(text or "")
        assert got[doc]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), doc
        assert set(filter(None, base.split(","))) <= set(got[doc]["spans"].split(","))
        assert got[doc]["n_email"] == base.count("email:")
    added = got[9]["spans"]
    assert {s.split(":")[0] for s in added.split(",")} >= {"email", "phone", "ip"}
    assert got[10]["spans"] == ""
    held = pii._scored(model, pii.VectorAssembler(inputCols=list(pii._FEATURES), outputCol="features").transform(pii.examples(spark, 800))).select("kind", "label", "probability").collect()
    taken = [r for r in held if r["probability"] >= limits[r["kind"]]]
    assert sum(r["label"] for r in taken) >= 0.95 * len(taken)
    assert sum(r["label"] for r in taken) >= 0.7 * sum(r["label"] for r in held)
    assert pii.find(none, model, limits).count() == 0
    assert pii.redact(rows.filter("doc_id = 3"), model, limits).first()["text"].startswith("[IP].5 999.1.1.1 [IP]")


def test_pii_runs_no_python(spark, docs, capsys):
    model, limits = pii.train(spark, rows=500)
    pii.digest(pii.find(docs, model, limits)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_html(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_text.learn_weights(pages)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, weights).collect()}
    from html import unescape

    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)
    page = '<body><div class="top-nav">x y</div><main><header><h1>T &lt;a</h1></header><p>one  two<p>three <a href=x>four</a> <script>if (a<b) {}</script><aside>no no no</aside> five six<form>sss</form><p>more here</p><div id="comments">bad <p>bad</p></div></main><footer>f</footer>'
    assert html_text.extract(page, weights) == "T <a\none two\nthree four\nfive six\nmore here"
    assert html_text.extract(None, weights) == html_text.extract("", weights) == html_text.extract("<nav>a</nav>", weights) == ""
    free = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><p>plain words here are many and good</p><p>more words</p><div class=sidebar>side text</div>"
    assert html_text.extract(free, weights) == "plain words here are many and good\nmore words"
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert html_text.extract_text(odd, weights).count() == 2
    assert html_text.extract_text(odd.filter("false"), html_text.learn_weights(odd.filter("false"))).count() == 0


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def planted_edits(kind):
    """Lines of 8 to 40 invented words and a copy of each with one word or one character changed, at edit similarity 0.85 at least."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(n)) for n in rng.integers(1, 6, 3000)]
    out = []
    while len(out) < 400:
        own = [words[i] for i in rng.integers(0, len(words), rng.integers(8, 41))]
        new, i = list(own), rng.integers(len(own))
        new[i] = words[rng.integers(len(words))] if kind == "word" else new[i][:-1] + "x"
        one, two = " ".join(own), " ".join(new)
        if one != two and plain_edits(one, two) <= int(0.15 * max(len(one), len(two))):
            out.append((one, two))
    return out


@pytest.mark.parametrize("kind", ["word", "character"])
def test_lines_with_one_edit_are_found(spark, kind):
    pairs = planted_edits(kind)
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    got = {r["doc_id"]: r["n_removed_"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] for i in range(len(pairs))) == 0
    assert sum(got[2 * i + 1] for i in range(len(pairs))) >= 0.98 * len(pairs)


def test_lines_of_one_hash_are_all_compared(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}word" for a in "bcdf" for b in "aeiou"]
    forms = [" ".join(words[i] for i in rng.permutation(20)) for _ in range(40)]
    rows = [(2 * i + k, line) for i, form in enumerate(forms) for k, line in enumerate((form, form[:40] + form[40:].replace(form.split()[-1], form.split()[-2])))]
    want = {d for d, _ in rows if d % 2}
    got = {r["doc_id"]: r["n_removed_"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, n in got.items() if n} == want


def test_vectors_are_fitted_on_all_documents_and_words_counted_exactly(spark, docs):
    rows = docs.select("doc_id", "text").limit(60)
    last = spark.range(20_100).selectExpr("id + 1000000 AS doc_id").orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    text = F.when(F.col("doc_id") == last, "solitary unusualwording herein").otherwise("sole subject of these many")
    many = decontaminate.tokenized(spark.range(20_100).select((F.col("id") + 1_000_000).alias("doc_id")).withColumn("text", text))
    terms = decontaminate.word_ids("solitary unusualwording herein", decontaminate._Ids()) & np.uint32(decontaminate.TERMS - 1)
    basis = decontaminate.latent_basis(many, decontaminate.term_weights(many)[0], rank=4, common=0)
    assert (np.abs(basis[terms]).sum(axis=1) > 0).all()  # the document of greatest hash is in no sample
    ids = decontaminate.tokenized(rows)
    own = [decontaminate.word_ids(r["text"], decontaminate._Ids()) for r in rows.collect()]
    known = np.unique(np.concatenate(own))
    want = [sum(w in set(x[i : i + decontaminate.PASSAGE].tolist()) for x in own for i in range(0, len(x), decontaminate.PASSAGE)) for w in known[:50].tolist()]
    assert decontaminate.passages_with(ids, known)[:50].tolist() == want


def test_verbatim_passages_need_no_vectors(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect() if len(decontaminate.word_ids(r["text"], decontaminate._Ids())) >= 8}
    other = [x for r in docs.select("text").limit(40).collect() for x in (r["text"] or "").split()]
    rows = [(i, " ".join(other[7 * k : 7 * k + 50 + k % 9] + text.split() + other[7 * k + 60 : 7 * k + 120])) for k, (i, text) in enumerate(items.items())]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, cosine=2.0)
    assert {(i, i) for i in items} <= {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_language_sample_is_taken_in_parts(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 5 < 3 THEN 'en' ELSE 'fr' END AS lang", "xxhash64(id) AS `order`")
    found = langid.least_of_each(rows, 100)
    want = {lang: sorted(((r["order"], r["doc_id"]) for r in rows.collect() if r["lang"] == lang))[:100] for lang in ("en", "fr")}
    got = found.collect()
    assert {lang: sorted((r["order"], r["doc_id"]) for r in got if r["lang"] == lang) for lang in want} == want
    assert "salt" in found.columns


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoding_of_the_queries_is_the_librarys_own(texts, file, spaced):
    own = [*list(texts.values())[60:120], "", "hi <|endoftext|> x", "<|startoftext|>A<|endoftext|>", "<|endoftext|>", "a <|endoftex t|>", "\r\n\t x y", "１２ ½ ǅ", "x" * 5000, " " * 3000 + "y", "á ퟿"]
    whole = Tokenizer.from_file(public_path(file))
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(public_path(file), spaced).encode(own)]
    assert got == [x.ids for x in whole.encode_batch(own, add_special_tokens=False)]


def test_similar_lines_of_the_small_table_are_found(spark, docs, texts):
    """Every pair of distinct lines with edit similarity 0.85, by comparing all pairs: nine in ten end in one group."""
    forms = sorted({f for t in texts.values() for x in t.split("\n") if len((f := lines.normalised(x)).split()) >= 3}, key=len)
    counts = np.array([np.bincount([ord(c) % 300 for c in f], minlength=300) for f in forms])
    sizes = np.array([len(f) for f in forms])
    want = []
    for i, f in enumerate(forms):
        ahead = i + 1 + np.flatnonzero(sizes[i + 1 :] - sizes[i] <= 0.15 * sizes[i + 1 :])
        less = counts[ahead] - counts[i]
        near = np.maximum(np.maximum(less, 0).sum(axis=1), np.maximum(-less, 0).sum(axis=1)) <= 0.15 * sizes[ahead]
        want += [(f, forms[j]) for j in ahead[near].tolist() if lines.edits(f, forms[j]) <= int(0.15 * sizes[j])]
    assert len(want) > 30
    gone = lines.repeated_lines(docs.select("doc_id", "text")).collect()
    removed = {(r["doc_id"], i) for r in gone for i in r["lines"]}
    places = {}
    for d, t in texts.items():
        for i, x in enumerate(t.split("\n")):
            places.setdefault(lines.normalised(x), []).append((d, i))
    # of two similar lines at most one form still has an occurrence, unless a third form was the first of both
    found = sum(any(all(p in removed for p in places[f]) for f in pair) for pair in want)
    assert found >= 0.9 * len(want)


def test_short_lines_that_repeat_go_on_request(spark):
    rows = [(1, "And.\nsome other words here"), (2, "and\n\nnew words stand here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t_", F.lit(1)).withColumn("doc_id_", F.lit(2)).withColumn("n_removed_", F.lit(9)).withColumn("lines", F.lit("x"))
    got = {r["doc_id"]: r for r in lines.without_repeats(frame, short=True).collect()}
    assert got[2]["text"] == "\nnew words stand here"
    assert got[1]["text"] == rows[0][1]
    assert (got[2]["n_removed_"], got[2]["t_"], got[2]["doc_id_"], got[2]["lines"]) == (1, 1, 2, "x")
    assert {r["n_removed_"] for r in lines.without_repeats(frame).collect()} == {0}


def test_bounded_alignment():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = ([int(x) for x in rng.integers(0, 4, rng.integers(0, 40))] for _ in range(2))
        d = plain_edits(a, b)
        assert alignment.by_bits(a, b) == d
        for limit in (0, 3, 10, 30):
            assert alignment.edits_within(a, b, limit) == (d if d <= limit else None)
            x, y = (" ".join("abcd"[i] for i in w) for w in (a, b))
            assert alignment.texts_within(x, y, limit) == (plain_edits(x, y) <= limit)


def test_a_passage_that_many_share_does_not_hide_copies(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(4000)]
    draw = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    shared = draw(120)
    rows = [(2 * i, draw(20) + shared + draw(20)) for i in range(150)]
    rows += [(i + 1, [*own[:3], "changed", *own[4:150], "x", *own[151:]]) for i, own in rows[:20]]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame, similarity=0.9, crowd=8).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(20))
    assert len(set(got.values())) == 150


def test_redaction_is_by_row(spark):
    model, limits = pii.train(spark, rows=500)
    rows = [(1, "nothing at all here"), (1, "mail a.b@c.de now"), (None, "x@y.zz tail")]
    got = sorted(r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), model, limits).collect())
    assert got == ["[EMAIL] tail", "mail [EMAIL] now", "nothing at all here"]
