"""Chat formatting, byte-level BPE, personal data and its tagger against brute force and exact round trips."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from pyspark.sql import functions as F

from docflow.llm import bpe, chat, common, pii
from docflow.llm.tagger import Tagger

SIGNS = ["a", "B", "1", "2", "9", ".", "@", "+", "-", " ", "(", ")", "1.2.3.4", "a@b.c", "4111111111111111", "é", "+1 (555) 555-1234", "_", "%", "\n", "漢", "😀", "the", "ing", "  ", "'s"]


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    import tiktoken

    own = bpe.Bpe(bpe.default_vocabulary())
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_tiktoken(codec):
    own, other = codec
    r = random.Random(1)
    for _ in range(800):
        s = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 40)))
        assert own.encode(s) == other.encode_ordinary(s)
        assert own.decode(own.encode(s)).decode() == s
        assert own.ids_text(s) == (" ".join(map(str, other.encode_ordinary(s))), len(other.encode_ordinary(s)))
    for s in ("a" * 3000, " " * 2000, "ab" * 1000, "é" * 500):
        assert own.encode(s) == other.encode_ordinary(s)


def test_bpe_appends_and_edits(codec):
    own, _ = codec
    r = random.Random(2)
    for _ in range(100):
        s = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 300))).encode()
        p = bpe.Prefix(own, s[: len(s) // 2])
        p.append(s[len(s) // 2 :])
        assert p.tokens() == own.walk(bpe.Prefix(own, s).last)
        i = r.randint(0, len(s))
        j = r.randint(i, min(len(s), i + 5))
        new = r.choice(["", "x", "the 漢"]).encode()
        p.replace(i, j, new)
        assert p.tokens() == bpe.Prefix(own, s[:i] + new + s[j:]).tokens()
    long = bpe.Prefix(own, b"the quick brown fox " * 200)
    assert long.replace(1000, 1001, b"zz") < 600


def test_bpe_cache_is_bounded(codec, monkeypatch):
    own, other = codec
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    text = " ".join(f"w{i} x" for i in range(50))
    assert own.ids_text(text)[0] == " ".join(map(str, other.encode_ordinary(text)))
    assert len(own._now) <= max(5, 0) + len(own._before) + 1


ROWS = "doc_id long, text string, extra string"


def test_bpe_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "a", "x"), (4, "q " * 50000, "x")]
    got = bpe.digests(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    empty = sha256(b"").hexdigest()
    assert (by[1].n_tokens, by[1].ids_sha256, by[1].decoded_sha256) == (0, empty, empty)
    assert by[3].decoded_sha256 == sha256(b"hello world").hexdigest()
    assert bpe.digests(spark.createDataFrame([], ROWS)).count() == 0
    assert bpe.encoded(spark.createDataFrame(rows[2:3], ROWS)).first().decoded == b"hello world"


CONV = "conv_id long, turn long, role string, text string"


def _conversations():
    r = random.Random(3)
    bits = ["### ", "</turn>", "\\", "\n", "#", "##", ": ", "ok", "é", "### assistant: "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "as:k###"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for c in range(30) for t in range(r.randint(1, 5))]
    return [*rows, (99, 0, "assistant", None), (99, 1, None, "x"), (None, 0, "user", "n"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(_conversations(), CONV)
    got = {r.conv_id: r for r in chat.read_back(chat.placed_turns(df, block=None)).collect()}
    by = {}
    for c, t, role, text in _conversations():
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        if c != 7 and len({t for t, *_ in turns}) == len(turns):
            turns.sort(key=lambda x: x[0])
            assert got[c].turns_sha256 == sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            said = "".join(x for _, r, x in turns if r == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
            assert got[c].formatted_chars == sum(len(f"### {chat.escape_role(r)}: {chat.escape(x)}</turn>\n") for _, r, x in turns)
    assert chat.read_back(chat.placed_turns(spark.createDataFrame([], CONV))).count() == 0


def test_chat_masks_are_prefix_sums(spark):
    df = spark.createDataFrame(_conversations(), CONV).where("conv_id < 30 and conv_id <> 7")
    t = chat.template(bpe.default_vocabulary())
    found = []
    for block in (2, 1000, None):
        by = {}
        for r in chat.placed_turns(df, block=block).collect():
            by.setdefault(r.conv_id, []).append(r)
        found.append(sorted((c, r.turn, r.token_from, r.char_from, r.loss_from or -1) for c, rows in by.items() for r in rows))
        for rows in by.values():
            rows.sort(key=lambda r: r.token_from)
            ids = [i for r in rows for i in r.ids]
            whole = t.render(ids)
            for r in rows:
                assert ids[r.token_from : r.token_from + len(r.ids)] == r.ids
                if r.loss_from is not None:
                    masked = t.text(ids[r.loss_from : r.loss_to])
                    assert chat.unescape(masked) == t.turns(r.ids)[0][1] and whole[r.loss_char_from : r.loss_char_from + len(masked)] == masked
    assert found[0] == found[1] == found[2]


def test_chat_ties_and_clashing_columns(spark):
    """Turns that share a number come in the order of their ids, whatever the order of the rows; the mask stands for them."""
    rows = [(1, 5, "assistant", f"said {k}", 3, 4) for k in range(6)] + [(1, 5, "user", None, 3, 4), (1, 5, "assistant", "said 2", 3, 4), (1, None, "assistant", "first", 3, 4), (2, 0, "assistant", "é" * 100_000, 3, 4)]
    shape = CONV + ", ids long, token_from long"
    t = chat.template(bpe.default_vocabulary())
    order = sorted(((r[1] is not None, r[1] or 0, t.encode(r[2], r[3] or "")[0], r[2], r[3] or "") for r in rows if r[0] == 1))
    said = "".join(x for *_, role, x in order if role == "assistant")
    for shuffled in (rows, rows[::-1]):
        for block in (3, None):
            got = {r.conv_id: r for r in chat.read_back(chat.placed_turns(spark.createDataFrame(shuffled, shape), block=block)).collect()}
            assert (got[1].n_turns, got[1].loss_sha256) == (9, sha256(said.encode()).hexdigest())
            assert got[1].turns_sha256 == sha256("".join(f"{r}\n{x}\n" for *_, r, x in order).encode()).hexdigest()
            places, at = [], 0
            for *_, role, x in order:
                if role == "assistant":
                    places.append(f"{at + 15}:{at + 15 + len(x)}")
                at += len(f"### {role}: {x}</turn>\n")
            assert got[1].mask_sha256 == sha256(",".join(places).encode()).hexdigest()
            assert got[2].loss_chars == 100_000 and got[2].n_loss_tokens > 0


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _plain_spans(s):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, s):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 8 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


def test_pii_patterns():
    r = random.Random(4)
    for _ in range(6000):
        s = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(s) == _plain_spans(s)
    assert pii.base_spans("1" * 200_000) == []  # linear in a long run of digits


def test_tagger_gradients():
    r = np.random.default_rng(0)
    t = Tagger(5, 4)
    ids, tags = r.integers(0, 100, (3, 9)), r.integers(0, 5, (3, 9))
    _, g = t.gradients(ids, tags)
    for k in g:
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in t.p[k].shape)
            old = t.p[k][at]
            t.p[k][at] = old + 1e-5
            up = t.gradients(ids, tags)[0]
            t.p[k][at] = old - 1e-5
            down = t.gradients(ids, tags)[0]
            t.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5


def test_pii_trains_on_copies(spark):
    """A table of copies has a tagger too, whatever their number, and so has one of empty texts."""
    shape = "doc_id long, text string"
    for rows in ([(1, "write to jo at site dot com")] * 1000, [(i, "the same words") for i in range(700)], [(1, None), (2, "")]):
        assert pii.train(spark.createDataFrame(rows, shape), steps=1) is not None
    assert pii.train(spark.createDataFrame([], shape), steps=1) is None
    texts = common.hash_sample(spark.createDataFrame([(1, "x")] * 5000 + [(2, "y" * 50)], shape), [F.col("text")], 3, F.substring("text", 1, 9))
    assert set(texts) <= {"x", "y" * 9} and 1 <= len(texts) == len(set(texts))


def test_pii_held_out(spark):
    """Trained with the production sample and steps; measured on made-up spans set into other rows, and on the rows themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.tagger_of(pii.train(docs.where("doc_id % 2 = 0"), id_col="doc_id"))
    texts = [x.text for x in docs.where("doc_id % 2 = 1 and length(text) > 0").select("text").limit(600).collect()]
    maker = pii.Maker(99)
    made = [maker.set_into(texts[k % len(texts)]) for k in range(1000)]
    hidden = added = right = 0
    for (_, spans), (base, every) in zip(made, pii.all_spans(tagger, [t for t, _ in made]), strict=True):
        assert set(base) <= set(every)
        own = {s for s in spans if all(b[1] >= s[2] or b[2] <= s[1] for b in base)}  # what the patterns don't find
        more = set(every) - set(base)
        hidden, added, right = hidden + len(own), added + len(more), right + len(more & set(spans))
    assert hidden > 300 and right >= 0.9 * added and right >= 0.8 * hidden
    found = pii.all_spans(tagger, texts)
    for text, (base, every) in zip(texts, found, strict=True):
        for kind, a, b in set(every) - set(base):
            assert pii.fits(kind, text[a:b])
            assert pii.KINDS[kind] != "card" or pii.luhn(re.sub("[^0-9]", "", pii.plain(text[a:b])))
    secrets = [sum(text[a:b] in t for t in (text,)) for text, (_, every) in zip(texts, found, strict=True) for k, a, b in every if pii.KINDS[k] == "secret"]
    assert sum(len(re.findall('token = "[0-9a-f]{40}"', t)) for t in texts) * 0.9 <= len(secrets)


def test_pii_windows_join_up():
    class Whole:
        def decode(self, ids):
            return np.where((ids >= 17) & (ids <= 26), 6, 0).astype(np.int8)  # digits are further card characters

    text = "x" * 90 + "7" * 550 + "y" * 90
    assert pii.predicted(Whole(), [text, "", "none", "5"]) == [[(2, 90, 640)], [], [], [(2, 0, 1)]]
    assert pii.predicted(Whole(), []) == []


def test_tagger_skips_only_what_is_all_zero():
    """decode() leaves windows out by a bound; what it returns is the best path over all windows."""
    r = np.random.default_rng(3)
    for scale in (0.2, 1.0, 3.0):
        t = Tagger(5, 4)
        t.p = {k: v * scale for k, v in t.p.items()}
        t.p["move"] = r.normal(0, scale, (5, 5))
        t.p["bo"] = np.array([3.0, 0, 0, 0, 0]) * scale
        ids = r.integers(0, 100, (40, 12)).astype(np.uint8)
        e = t.emissions(np.ascontiguousarray(ids.T)).astype(float)
        for row, tags in enumerate(t.decode(ids)):
            score, back = t.p["start"] + e[0, row], []
            for x in e[1:, row]:
                paths = score[:, None] + t.p["move"]
                back.append(paths.argmax(axis=0))
                score = paths.max(axis=0) + x
            best = [int(score.argmax())]
            for b in reversed(back):
                best.append(int(b[best[-1]]))
            assert tags.tolist() == best[::-1]


def test_tagger_scores_by_definition_and_cheaply(monkeypatch):
    """Scores are those of the training pass, also where gates are saturated; each gate costs one exp and no tanh, twice as dear, and few windows are traced back for nothing."""
    text, maker, r = "The quick words of a plain text, in (2) lines; see figure 3.1 and the rest of it. " * 40, pii.Maker(3), np.random.default_rng(1)
    tagger = Tagger(1 + 2 * len(pii.KINDS))
    tagger.fit(*pii.examples([text], 300), steps=60)
    some = r.integers(0, 100, (60, 7)).astype(np.uint8)
    for scale in (1, 50):
        own = Tagger(tagger.k)
        own.p = tagger.p | {f"wx{d}": tagger.p[f"wx{d}"] * scale for d in "fb"}
        with np.errstate(all="raise", under="ignore"):
            got = own.emissions(some)
        assert np.abs(got - (np.concatenate([own._run(some, d) for d in "fb"], axis=2) @ own.p["wo"] + own.p["bo"])).max() < 1e-3
    windows = np.zeros((512, 384), np.uint8)
    for k in range(512):
        own = pii.char_ids(text[k : k + 250] + (maker.set_into(text)[0] if k % 64 == 0 else text[:150]))[:384]
        windows[k, : len(own)] = own
    ids = np.ascontiguousarray(windows.T)
    through = {"exp": 0, "tanh": 0}

    class Counting:
        def __getattr__(self, name):
            def counted(x, *args, **kw):
                through[name] += np.size(x)
                return getattr(np, name)(x, *args, **kw)

            return counted if name in through else getattr(np, name)

    monkeypatch.setattr("docflow.llm.tagger.np", Counting())
    tags = tagger.decode(windows)
    assert through == {"exp": 2 * 5 * tagger.h * windows.size, "tanh": 0}  # two directions, four gates and the cell
    differ = int(tags.any(axis=1).sum())
    assert differ > 0
    assert differ <= len(tagger._may_differ(tagger._scores(ids))) <= 2 * differ + 16


def test_pii_exact_checks():
    card = pii.KINDS.index("card")
    assert pii.fits(card, "4111.1111.1111.1111") and not pii.fits(card, "4111.1111.1111.1112") and not pii.fits(card, "0" * 16)
    assert pii.fits(1, "2001:db8::1") and not pii.fits(1, "12:30") and pii.fits(0, "ann at mail dot org") and not pii.fits(0, "ann at home")
    assert pii.fits(3, "030/123456") and not pii.fits(3, "1234567890") and pii.fits(4, "a1" * 10) and not pii.fits(4, "password")


def test_pii_long_text_and_clashing_columns(spark):
    long = "plain words " * 200_000 + "mail a@b.co end"
    df = spark.createDataFrame([(1, long, 7, 8)], "doc_id long, text string, spans long, n_ip long")
    params = pii.train(df, steps=2)
    got = pii.find(df, params=params).first()
    assert got.n_email == 1 and got.spans.startswith(f"email:{len(long) - 15 + 5}:")
    red = pii.redact(df, params=params)
    assert red.columns == df.columns and red.first().spans == 7


def test_pii_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a@b.co now 10.0.0.1", "x"), (3, "mail a@b.co now 10.0.0.1", "x"), (None, "call +1 (555) 555-1234", "x")]
    df = spark.createDataFrame(rows, ROWS)
    params = pii.train(df, steps=2)
    got = pii.find(df, params=params).collect()
    assert len(got) == 5
    three = next(r for r in got if r.doc_id == 3)
    assert (three.n_email, three.n_ip, three.n_card, three.n_phone) == (1, 1, 0, 0)
    assert three.base_sha256 == sha256(b"email:5:11,ip:16:24").hexdigest()
    red = {r.doc_id: r for r in pii.redact(df, params=params).collect()}
    assert red[3].text == "mail [email] now [ip]" and red[1].text is None and red[3].extra == "x"
    none = spark.createDataFrame([], ROWS)
    assert pii.train(none) is None and pii.find(none).count() == 0 and pii.redact(none).count() == 0
