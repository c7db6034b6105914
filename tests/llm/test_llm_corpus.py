"""SimHash, decontamination, quality rules, WARC, HTML and the pipeline against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from docflow.llm import decontaminate, html_text, quality, simhash, warc

ROWS = "doc_id long, text string, extra string"


def _fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Ä", "A"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 80, 300]))) for _ in range(60)]
    for _ in range(60):
        words = r.choice(texts).split()
        if words:
            words[r.randrange(len(words))] = "odd"
        texts.append(" ".join(words))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", "x"), (502, "  \n", "x"), (None, texts[0], "x"), (3, texts[3], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t, _ in rows[:-2]]
    fps = [_fingerprint(t) for _, t in known]
    want = _components([i for i, _ in known], fps)
    for r_ in got:
        if r_.doc_id is None:
            assert r_.component_id is None
        else:
            assert r_.fp & (2**64 - 1) == fps[[i for i, _ in known].index(r_.doc_id)] and r_.component_id == want[r_.doc_id]
    assert simhash.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_simhash_links_lose_nothing(spark):
    """Dense groups, split units and large tiles give the components of brute force."""
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        x = c
        for _ in range(60):
            x = c if r.random() < 0.5 else x
            for b in r.integers(0, 64, r.integers(0, 3)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = _components(list(range(len(fps))), fps)
    for tile_rows in (simhash.TILE_ROWS, 9):
        stars = {s.a: s.root for s in simhash.connected(simhash.links(nodes, tile_rows)).collect()}
        assert {i: stars.get(i, i) for i in range(len(fps))} == want


def test_connected_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.a: r.root for r in simhash.connected(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}


def _words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark):
    r = random.Random(3)
    pick = lambda n: " ".join(r.choice(["a", "b", "É", "7x"]) for _ in range(n))
    items = [(i, pick(n)) for i, n in enumerate([3, 3, 13, 14, 20, 5, 12])] + [(20, None), (21, "..."), (22, "Solo"), (None, "q w e")]
    docs = [(i, pick(r.randint(0, 60)) + r.choice(["", " " + items[4][1].upper(), "-" + items[3][1]]), "x") for i in range(50)] + [(60, None, "x"), (61, "", "x"), (62, "solo, and more", "x"), (62, "solo, and more", "x"), (None, "q w e", "x")]
    got = decontaminate.hits(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    wins = {}
    for i, t in items:
        w = _words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    want = []
    for i, t, _ in docs:
        w, hit, seen = _words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    seen |= wins[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), tuple(sorted(x for x in seen if x))))
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((g.doc_id, g.n_words, g.n_hit, tuple(x for x in g["items"] if x)) for g in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {g.n_hit for g in decontaminate.hits(spark.createDataFrame(docs, ROWS), empty).collect()} == {0}
    assert decontaminate.hits(spark.createDataFrame([], ROWS), empty).count() == 0
    left = decontaminate.remove_documents(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "extra"]
    bad = {i for (i, n, h, _) in want if h and 20 * h >= n}
    assert {x.doc_id for x in left.collect()} == {i for i, *_ in docs} - bad


def _repeats(words):
    g = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, x in enumerate(g) if g.count(x) > 1 for j in (i, i + 1, i + 2)})


def test_quality(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a ", "b ", "c\n", "É ", "# ", "word|x ", "\t", "\n\n", "a b c\n"]) for _ in range(r.randint(0, 120))), "x") for i in range(60)]
    rows += [(90, None, "x"), (91, "", "x"), (92, " \n \t", "x"), (93, "one two three " * 3000, "x"), (94, " ".join(f"u{i}" for i in range(60)), "x"), (94, " ".join(f"u{i}" for i in range(60)), "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, ROWS)
    got = quality.quality(df).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for i, t, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        g = by[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if len(w) < 2000:
            assert g.n_repeat_words == _repeats(w)
        assert g.base_failed == (len(w) < 50 or 100 * g.n_repeat_words > 50 * len(w)) and not (g.base_failed and g.kept)
    assert by[93].n_repeat_words == 9000 and by[94].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(g.doc_id for g in got if g.kept)
    assert quality.quality(spark.createDataFrame([], ROWS)).count() == 0


def test_quality_order_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality._split(docs, "text", doc_id=docs.doc_id)
    c = quality.counts(rows.t, rows.w)
    a, b = (rows.select("doc_id", quality.kept(order, c).alias("k")) for order in (sorted(quality.rules(c)), sorted(quality.rules(c), reverse=True)))
    assert a.exceptAll(b).count() == 0


def test_quality_skips_what_follows(spark):
    """A row that a cheap rule rejects never reaches the counts of the rules behind it."""
    from pyspark.sql import functions as F

    rows = quality._split(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), "text")
    c = quality.counts(rows.t, rows.w)
    fails = F.raise_error(F.lit("counted"))
    spared = c | {k: fails.cast("boolean" if k == "mostly_dup_lines" else "long") for k in c if k != "n_words"}
    order = ["few_words", *(x for x in quality.rules(c) if x != "few_words")]
    assert rows.where(quality.kept(order, spared)).count() == 0
    with pytest.raises(Exception, match="counted"):
        rows.where(quality.kept(order[::-1], spared)).count()


def test_quality_worth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = quality.worth(docs, repeats=4)
    assert found["repeat_words"][1] > found["few_words"][1] and set(found) == set(quality.cascade(docs))
    assert quality.cascade(docs)[0] == "few_words" and all(0 <= share <= 1 for share, _ in found.values())


def test_quality_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a " * 80, 7, 8, 9), (2, " ".join(f"w{i}" for i in range(60)), 7, 8, 9)], "doc_id long, text string, t long, w long, q long")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.collect()] == [(7, 8, 9)]
    assert {r.doc_id: r.kept for r in quality.quality(df).collect()} == {1: False, 2: True}


quality.REPEATS = quality.TRIES = 1  # the order that comes of it changes no result

PAGES = "page_id long, url string, html string, extra string"


def test_warc(spark, tmp_path):
    big = "ÄÖ é\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [(5, "http://a/x y", "x" * 100, "e"), (3, "http://a/1", "x" * 100, "e"), (4, None, "x" * 99, "e"), (6, "u", "x" * 99, "e"), (7, "u", None, "e"), (8, "u", "", "e"), (9, "u", big, "e"), (10, "u", big, "e"), (10, "u", big, "e"), (None, "u", big, "e"), (11, "u", "\r\n\r\n", "e")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, segment_bytes=1000)
    got = warc.read_archives(spark, path, keep_payload=True).collect()
    assert len(got) == len(rows) and all(g.valid for g in got)
    names = [re.match(r"<urn:page:(-?\d*)", g.origin)[1] for g in got]
    kinds = sorted((n, g.kind, g.refers_to) for n, g in zip(names, got, strict=True))
    assert kinds.count(("10", "revisit", "<urn:page:9>")) == 2 and ("5", "revisit", "<urn:page:3>") in kinds and ("", "response", None) in kinds
    text = {str(i): (h or "").encode() for i, _, h, _ in rows}
    for n, g in zip(names, got, strict=True):
        want = text.get(n, big.encode())
        assert g.payload_bytes == len(want) and g.payload_digest == sha256(want).hexdigest()
        assert g.kind == "revisit" or g.payload == want
    empty = str(tmp_path / "empty")
    warc.write_archives(spark.createDataFrame([], PAGES), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_faults():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello" * 100, 7)

    def read(parts, total, stated="sha256:" + sha256(b"hello" * 100).hexdigest()):
        r = warc.Reader(stated)
        for n, p in parts:
            list(r.feed(n, total if n == parts[-1][0] else None, p))
        return r.valid()

    assert read([(1, block[:50]), (2, block[50:])], len(block))
    assert not read([(1, block[:50]), (3, block[50:])], len(block))
    assert not read([(1, block[:50]), (2, block[50:])], len(block) + 1)
    assert not read([(1, block[:-9])], len(block) - 9)
    assert not read([(1, block)], len(block), "md5:" + "0" * 32)


def _record(kind="response", name="<urn:x:1>", block=b"HTTP/1.1 200 OK\r\n\r\nbody", version=b"WARC/1.0", length=None, **more):
    lines = [f"WARC-Type: {kind}"] + ([f"WARC-Record-ID: {name}"] if name else []) + [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return version + b"\r\n" + "\r\n".join(lines).encode() + b"\r\nContent-Length: " + str(len(block) if length is None else length).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["no", "whole", "members"])
def test_warc_foreign_archives(spark, tmp_path, packed):
    """Archives of other writers: other digests, odd records, a member of gzip a record. What can't be read is left out, and counted."""
    import base64
    import gzip
    import hashlib

    body = b"WARC/1.0 is a format\r\n\r\nWARC/1.0\r\n\r\n" * 3000
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    parts = [
        _record("warcinfo", "<urn:x:0>", b"software: x\r\n"),
        _record(name="<urn:x:1>", block=block, WARC_Payload_Digest=f"sha1:{sha1}"),
        _record(name="<urn:x:2>", block=block, WARC_Payload_Digest=f"md5:{hashlib.md5(body).hexdigest()}"),
        _record(name="<urn:x:3>", block=block, WARC_Payload_Digest="crc32:1234"),
        _record(name="<urn:x:4>", block=block, WARC_Payload_Digest="sha1:" + "A" * 32),
        _record(name=None),
        _record(name="<urn:x:5>", WARC_Segment_Number="one"),
        _record(name="<urn:x:6>", length="many"),
        _record(name="<urn:x:7>", length=10**15),
        _record(name="<urn:x:8>", block=b""),
        _record(name="<urn:x:9>", version=b"WARC/1.1"),
        _record(name="<urn:x:10>", block=b"HTTP/1.1 200 OK\r\n\r\nWARC/", length=10**6),
        _record(name="<urn:x:11>", block=b"HTTP/1.1 200 OK\r\n\r\nlast"),
    ]
    (tmp_path / "w").mkdir()
    for i in range(2):
        data = b"".join(parts).replace(b"urn:x:", f"urn:f{i}:".encode())
        name, data = {"no": ("a.warc", data), "whole": ("a.warc.gz", gzip.compress(data)), "members": ("a.warc.gz", b"".join(gzip.compress(p.replace(b"urn:x:", f"urn:f{i}:".encode())) for p in parts))}[packed]
        (tmp_path / "w" / f"{i}-{name}").write_bytes(data)
    (tmp_path / "w" / f"empty-{name}").write_bytes(gzip.compress(b"") if packed != "no" else b"")
    (tmp_path / "w" / f"junk-{name}").write_bytes(gzip.compress(b"no archive") if packed != "no" else b"no archive")
    got = {g.origin: g for g in warc.read_archives(spark, str(tmp_path / "w"), keep_payload=True).collect()}
    assert set(got) == {f"<urn:f{i}:{n}>" for i in range(2) for n in (1, 2, 3, 4, 8, 9, 11)}
    for i in range(2):
        own = {n: got[f"<urn:f{i}:{n}>"] for n in (1, 2, 3, 4, 8, 9, 11)}
        assert [own[n].valid for n in (1, 2, 3, 4, 8, 9, 11)] == [True, True, True, False, False, True, True]
        assert all(own[n].payload == body and own[n].payload_digest == sha256(body).hexdigest() for n in (1, 2, 3, 4)) and own[11].payload == b"last"
    bad = [x.reason for x in warc.malformed(spark, str(tmp_path / "w")).collect()]
    assert len(bad) >= 11 and "no id" in bad and "segment number" in bad and "the archive ends inside the record" in bad and "bytes before the first record" in bad


HTML = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav><div class="cookie notice">We use</div>
<article><h1>A &amp; B</h1><p>One<b> bold<br>two<p>Three &eacute;<script>var t="</p>";</script><div id="comments"><p>Nice!</div><aside>see</aside><ul><li>x<li>y</ul><form>q<input></form></article>
<footer>&copy; f</footer><div class="ad">Buy</div>"""


def test_html():
    assert html_text.main_text(HTML) == "A & B\nOne bold two\nThree é\nx\ny"
    assert html_text.main_text("") == "" and html_text.main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert html_text.main_text("<p>a<!-- <p>no --> b<p title='x>y'>c") == "a b\nc"


def test_html_style_tree(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(i, f"http://s.example/{i}", f"<body><div class=wrap><p>Site slogan here</p><p>Article {words[i]} about {words[i + 100]}</p></div></body>", "e") for i in range(100)]
    rows += [(200, None, None, "e"), (201, "odd", "", "e"), (202, "http://s.example/c", "<article><p>Site slogan here</p></article>", "e"), (202, "http://s.example/c", "<article><p>Site slogan here</p></article>", "e")]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {g.page_id: g.text for g in got}
    assert all(by[i] == f"Article {words[i]} about {words[i + 100]}" for i in range(100))
    assert by[200] == by[201] == "" and by[202] == "Site slogan here"
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_pipeline(spark):
    """All columns of the rows: verdicts, components and hits by brute force, tokens and digests by the tiktoken library over texts redacted with the spans of the stage's tagger."""
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from docflow.llm import pii

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "personal_data", "byte_bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = [i for i, t in rows.items() if _good(t or "")]
    ids = sorted(good)
    first = _components(ids, [_fingerprint(rows[i]) for i in ids])
    bench = [_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {tuple(w[k : k + min(13, len(w))]) for w in bench if w for k in range(len(w) - min(13, len(w)) + 1)}
    stay = {}
    for i in ids:
        w = _words(rows[i])
        hit = {j for n in {len(x) for x in wins} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins for j in range(k, k + n)}
        if first[i] == i and not (hit and 20 * len(hit) >= len(w)):
            stay[i] = rows[i]
    assert set(got) == set(stay)
    params = pii.train(docs.where(docs.doc_id.isin(list(stay))))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in f if line.strip())}
    codec = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    changed = 0
    for (i, text), (base, every) in zip(stay.items(), pii.all_spans(pii.tagger_of(params), list(stay.values())), strict=True):
        assert set(base) <= set(every)
        for kind, a, b in sorted(every, key=lambda x: -x[1]):
            if not any(x < a < y for _, x, y in every):
                end = max(y for _, x, y in every if x == a or a <= x < b)
                text = f"{text[:a]}[{pii.KINDS[kind]}]{text[end:]}"
        changed += text != stay[i]
        tokens = codec.encode_ordinary(text)
        assert got[i].n_tokens == len(tokens) and got[i].ids_sha256 == sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(text.encode()).hexdigest()
    assert changed > 5


def _good(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, chars, count = len(w), sum(map(len, w)), lambda p: len(re.findall(p, t))
    seen = {}
    for i in range(n - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    twice = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    bad = n < 50 or 100 * len(twice) > 50 * n or 10 * count("[#*$%&|<>]") > n or 2 * (len(lines) - len(set(lines))) > len(lines)
    return not (bad or not 2 * n <= chars <= 20 * n or 2 * count("[A-Z]") > chars or 4 * count("[!?]") > n)


def test_stages_tell_rows_apart(spark):
    """Rows that share an id with another text are documents of their own in every stage; columns may have any name."""
    import corpus_pipeline

    r = random.Random(8)
    text = lambda k: " ".join(f"w{r.randrange(900)}x{k}" for _ in range(90))
    a, b, c = text(1), text(2), text(3)
    item = " ".join(f"b{i}" for i in range(13))
    shape = "doc_id long, text string, n_chars long, row long, n_words long, items long, component_id long, _id long"
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (3, c + " " + item), (3, text(4))]
    docs = spark.createDataFrame([(*x, 0, 1, 2, 3, 4, 5) for x in rows], shape)
    left = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert left.columns == docs.columns and sorted(((x.doc_id or 0), x.text) for x in left.collect()) == sorted([(1, a), (2, b), (3, c + " " + item), (3, rows[-1][1])] if _near(c, c + " " + item) else [(1, a), (2, b), (0, c), (3, c + " " + item), (3, rows[-1][1])])
    clean = decontaminate.remove_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted((x.doc_id or 0, x.text) for x in clean.collect()) == sorted((i or 0, t) for i, t in rows if item not in t)
    hit = decontaminate.hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert len(hit.columns) == len(set(hit.columns)) and {x.n_hit for x in hit.collect()} == {0, 13}
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.columns == docs.columns and good.count() == len(rows)
    empty = docs.limit(0)
    for f in (simhash.keep_one, quality.keep_good):
        assert f(empty).count() == 0


def _near(x, y):
    return bin(_fingerprint(x) ^ _fingerprint(y)).count("1") <= 3


def test_decontamination_shuffled_join(spark, monkeypatch):
    """Beyond the size for a broadcast: the same rows, and the rows that stand for documents don't meet in one task."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefg") for _ in range(40)), "x") for i in range(300)], ROWS)
    items = spark.createDataFrame([(i, " ".join(r.choice("abcdefg") for _ in range(6))) for i in range(40)], "item_id long, text string")
    key = lambda g: (g.doc_id, g.n_words, g.n_hit, tuple(g["items"]))
    want = sorted(map(key, decontaminate.hits(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(key, decontaminate.hits(docs, items).collect())) == want and any(n for _, _, n, _ in want)


def test_long_texts(spark):
    long = "word " * 300_000 + "end"
    docs = spark.createDataFrame([(1, long, "x"), (2, long, "x"), (3, "b c d " + "e " * 20, "x")], ROWS)
    assert {g.doc_id: g.component_id for g in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    got = {g.doc_id: g.n_hit for g in decontaminate.hits(docs, spark.createDataFrame([(1, "word end")], "item_id long, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 0}


def test_style_tree_by_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    pages = []
    for host, n in (("a", 1), ("b", 7), ("c", 30)):
        for k in range(n):
            menu = "".join(f"<li>{x}</li>" for x in ("home", "news", "about")[: r.choice([2, 3])])
            body = "".join(r.choice([f"<p>{word()}</p>", f"<div class=x><p>{word()}</p>same</div>"]) for _ in range(r.randint(1, 4)))
            pages.append((host, f"<body><div><ul>{menu}</ul></div><div id=m>{body}</div></body>"))
    pages += pages[-3:] + [("d", None), ("d", "")]
    nodes, contents = html_text.style_tree(spark.createDataFrame(pages, "host string, html string"))
    seen, shown, texts = defaultdict(set), defaultdict(set), defaultdict(set)
    for host, page in pages:
        styles = []
        found = html_text.blocks(page or "", styles)
        whole = "\n".join(t for _, t, _, noise in found if not noise)
        seen[host].add(whole)
        for p, s in styles:
            shown[host, p].add((s, whole))
        for p, t, *_ in found:
            texts[host, p].add((t, whole))
    want_text, want_node = Counter(), {}
    for (host, p), own in texts.items():
        m = len(seen[host])
        for t, n in Counter(t for t, _ in own).items():
            want_text[host, p, html_text._hash(f"{p}\n{t}")] = 1.0 if m == 1 else 1 - math.log(n, m)
    for (host, p), own in shown.items():
        m, counts = len(seen[host]), Counter(s for s, _ in own)
        total = sum(counts.values())
        says = [(want_text[host, q, html_text._hash(f"{q}\n{t}")], n) for (h, q), x in texts.items() if h == host and (q == p or q.startswith(p + ">")) for t, n in Counter(t for t, _ in x).items()]
        if p and says:
            shows = 1.0 if m == 1 else -sum(n / total * math.log(n / total, m) for n in counts.values())
            fade = html_text.DAMPING ** len(counts)
            want_node[host, p] = (1 - fade) * shows + fade * sum(v * n for v, n in says) / sum(n for _, n in says)
    got_text = {(x.host, x.path, x.text): x.importance for x in contents.collect()}
    got_node = {(x.host, x.path): x.importance for x in nodes.collect()}
    assert got_text.keys() == want_text.keys() and all(abs(got_text[k] - want_text[k]) < 1e-9 for k in got_text)
    assert got_node.keys() == want_node.keys() and all(abs(got_node[k] - want_node[k]) < 1e-9 for k in got_node)
    assert min(got_node.values()) < html_text.LEAST_IMPORTANCE < max(got_node.values())


def test_html_tree_removes_unmarked_noise(spark):
    """A site whose pages repeat unmarked menus, teasers and footers, also inside articles: the tree finds over half of those blocks, and no main text."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    noise = {host: [" ".join(word() for _ in range(4)) for _ in range(6)] for host in range(5)}
    rows, main = [], {}
    for k in range(200):
        host = k % 5
        own = [" ".join(word() for _ in range(12)) for _ in range(5)]
        a, b, c, *rest = noise[host]
        rows.append((k, f"http://h{host}.example/{k}", f"<body><div class=top><p>{a}</p><p>{b}</p></div><article><p>{own[0]}</p><div><p>{c}</p></div>{''.join(f'<p>{x}</p>' for x in own[1:])}</article><div>{''.join(f'<p>{x}</p>' for x in rest)}</div></body>", ""))
        main[k] = own
    left = total = 0
    for g in html_text.extract(spark.createDataFrame(rows, PAGES)).collect():
        found = g.text.split("\n")
        assert [x for x in found if x in main[g.page_id]] == main[g.page_id]
        plain = html_text.main_text(rows[g.page_id][2]).split("\n")
        total += sum(x not in main[g.page_id] for x in plain)
        left += sum(x not in main[g.page_id] for x in found)
    assert total >= 200 and left == 0


def test_html_kept_inside_articles():
    t = html_text.main_text
    for inner in ("<div class='share-price-table'>kept</div>", "<p class='form-factor'>kept</p>", "<noscript>kept</noscript>", "<p><math><mi>kept</mi><annotation>no</annotation></math></p>", "<object>kept</object>"):
        assert t(f"<article><p>a</p>{inner}<p>b</p></article>").split() == ["a", "kept", "b"], inner
    assert t("<noscript>Enable scripts</noscript><p>a</p>") == "a"
    long = "<article>" + "<p>x y</p>" * 100_000 + "</article>"
    assert len(t(long)) == 400_000 - 1


def test_html_whole_main_texts():
    t = html_text.main_text
    assert t("<div class='text'><p>Main</p></div><section class='comments'><article><p>me too</p></article></section>") == "Main"
    for name in ("has-sidebar", "no-sidebar", "long-form", "with-comments", "related-work", "article-without-ads"):
        assert t(f"<body><div class='{name}'><article><p>Main</p></article></div></body>") == "Main", name
    for name in ("sidebar", "ad-slot-2", "site_footer", "cookie-banner", "x main-nav"):
        assert t(f"<div class='{name}'><p>noise</p></div><p>Main</p>") == "Main", name
    for tag in html_text.SKIPPED:
        assert t(f"<p>a <{tag} class='x'/>b</p><p>c</p>") == "a b\nc", tag
        assert t(f"<p>a <{tag}>no <i>text</i></{tag}>b</p><p>c</p>") == "a b\nc", tag
    for tag in ("svg", "button", "video", "select"):
        assert t(f"<div><div>a<{tag}>open</div><p>c</p></div>") == "a\nc", tag
    assert t("<p>a<svg><svg>x</svg><title/>y</svg>b<template><template>x</template><div>y</div></template>c</p><svg><path d='1'><p>d</p>") == "abc\nd"


def test_html_tree_inside_articles_on_small_hosts(spark):
    menu = "<div><span>More of our offers</span></div>"
    page = lambda k: f"<body><main>{menu}<article><p>{' '.join(f'a{k}x{i}' for i in range(20))}</p></article></main></body>"
    rows = [(m * 100 + k, f"http://h{m}.example/{k}", page(k), "") for m in (1, 2, 19, 20) for k in range(m)]
    rows += [(9000 + k, f"http://copies.example/{k}", page(1), "") for k in range(5)]
    rows += [(9100 + k, f"http://near.example/{k}", page(1).replace("a1x7 ", f"b{k} "), "") for k in range(5)]
    rows += [(9200 + k, f"http://parts.example/{k}", f"<article><p>{'one same long text of all the copies ' * 3}</p><p>copy {k}</p></article>", "") for k in range(5)]
    by = {g.page_id: g.text for g in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert "offers" in by[100] and all("offers" in by[9000 + k] for k in range(5))
    assert all("offers" not in by[m * 100 + k] and f"a{k}x19" in by[m * 100 + k] for m in (2, 19, 20) for k in range(m))
    assert all("a1x19" in by[9100 + k] and "same long text" in by[9200 + k] for k in range(5))


def test_html_menus_go_from_short_pages_too(spark):
    """What goes is decided over a host's pages: a menu goes from pages with few words of their own as from long ones, versions of one article stay whole."""
    menu = "<div><span>More of our offers and all our prices at a glance</span></div>"
    page = lambda k, n: f"<body><main>{menu}<article><p>{' '.join(f'a{k}x{i}' for i in range(n))}</p></article></main></body>"
    rows = [(k, f"http://short.example/{k}", page(k, 3 if k % 3 == 0 else 40), "") for k in range(20)]
    shared = "".join(f"<p>what all versions of this article say, part {i}</p>" for i in range(4))
    rows += [(100 + k, f"http://versions.example/{k}", f"<article>{shared}<p>version {k} of this</p></article>", "") for k in range(20)]
    # most pages are versions of one article; the others share one of its texts, and keep it as well
    rows += [(200 + k, f"http://mixed.example/{k}", f"<article>{shared if k < 17 else '<p>what all versions of this article say, part 0</p>'}<p>{f'own {k} ' * 20 if k >= 17 else f'version {k}'}</p></article>", "") for k in range(20)]
    rows += [(300 + k, None, page(k, 3), "") for k in range(2)] + [(400, "http://short.example/x", None, "")]
    by = {g.page_id: g.text for g in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(by[k] == " ".join(f"a{k}x{i}" for i in range(3 if k % 3 == 0 else 40)) for k in range(20))
    assert all(by[100 + k].count("what all versions") == 4 and by[100 + k].endswith(f"version {k} of this") for k in range(20))
    assert all(by[200 + k].count("what all versions") == (4 if k < 17 else 1) for k in range(20))
    assert by[400] == "" and len(by) == len(rows)


def test_clashing_columns_elsewhere(spark, tmp_path):
    """Columns of a caller that bear the names of an operator's own are left aside."""
    from docflow.llm import bpe, unigram

    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", "h", "p", "t", 5)], "page_id long, url string, html string, host string, payload string, text string, digest long")
    assert html_text.extract(pages).select("text").first().text == "x"
    warc.write_archives(pages, str(tmp_path / "w"))
    assert [(g.payload_bytes, g.valid) for g in warc.read_archives(spark, str(tmp_path / "w")).collect()] == [(8, True)]
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, n_tokens long, ids long")
    assert unigram.token_counts(docs).first().n_tokens < 7 and bpe.digests(docs).first().n_tokens < 7
    assert simhash.near_duplicates(docs.withColumnRenamed("ids", "fp")).first().component_id == 1
