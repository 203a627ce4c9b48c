"""Sale enrichment, tiered packing and collocations against brute force; texts in parts; odd tables in the pipeline."""

import datetime as dt
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

# ------------------------------------------------------------------ 11

START = dt.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, rec string, batch string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, balance double, id string"


def batch_of(day):
    return max(0, min(7, math.floor((day - 19723) * 8 / 152)))


def day_of(t):
    return (t - dt.datetime(1970, 1, 1)).days


def brute_enrich(sales, changes):
    """The rules, batch by batch and sale by sale."""
    none = dt.datetime(1, 1, 1)
    order = lambda v: (v["valid_at"], v["seq"] is not None, v["seq"] or 0, v["change_id"] is not None, v["change_id"] or 0)
    own = [dict(zip(("change_id", "client_id", "seq", "op", "valid_at", "source", "balance"), c, strict=True)) for c in set(changes) if c[4] is not None]
    for c in own:
        c["b"] = batch_of(day_of(c["valid_at"]) + (zlib.crc32(str(c["change_id"]).encode()) % 4 if c["change_id"] is not None else 0))
    queue = [(batch_of(day_of(s[5])) if s[5] else 7, s) for s in sales]
    out, versions, waiting = [], {}, []
    top = lambda times: max(times, default=None)
    for k in range(9):
        marks = [top([t for t in times if t is not None]) for times in ([s[4] for b, s in queue if b < k], [c["valid_at"] for c in own if c["b"] < k])]
        limits = [none if m is None else m - dt.timedelta(hours=12) for m in marks]
        h = min(limits)
        for c in own:
            if c["b"] == k:
                if c["valid_at"] < limits[1]:
                    out.append(("change", c["change_id"], k, None, None, None, None))
                else:
                    versions.setdefault(c["client_id"], []).append(c)
        waiting += [s for b, s in queue if b == k]
        for s in waiting:
            if k == 8 or s[4] is None or s[4] < h:
                held = versions.get(s[1], []) if s[1] is not None else []
                seen = [v for v in held if s[4] is not None and v["valid_at"] <= s[4]]
                best = max(seen, key=order, default=None)
                cents = math.floor(100 * best["balance"] + 0.5) if best and best["balance"] is not None else None
                out.append(("sale", s[0], k, len(held), best and best["change_id"], cents, best and best["op"]))
        waiting = [s for s in waiting if not (k == 8 or s[4] is None or s[4] < h)]
        for client, held in versions.items():
            passed = sorted((v for v in held if v["valid_at"] <= h), key=order)
            versions[client] = [v for v in held if v["valid_at"] > h] + passed[-1:]
    return out


def shop(seed, n=260):
    """Times on a coarse grid, some a microsecond beside it; a hot client, nulls, repeats, late and early rows."""
    rng = random.Random(seed)
    when = lambda top=600: START + dt.timedelta(hours=6 * rng.randrange(top), microseconds=rng.choice([0, 0, 0, 1, -1, 999]))
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, None])
    sales, changes = [], []
    for i in range(n):
        sold = rng.choice([when(), when(), when(), None, START - dt.timedelta(days=30_000)] if i % 25 == 0 else [when()])
        arrived = None if i % 90 == 5 else (sold or when()) + dt.timedelta(hours=rng.choice([0, 0, 5, 40, 900]))
        sales.append((i if i % 70 else None, client(), "open", 1.0, sold, max(arrived, START - dt.timedelta(days=3)) if arrived else None, 1, "r", "b"))
    sales += sales[:4]
    for i in range(n):
        changes.append((i if i % 80 else None, client(), rng.choice([0, 1, 2, None]), rng.choice("UID"), None if i % 40 == 3 else when(), "web", rng.choice([None, 1.005, -2.5, 7.25, 3.0])))
    return sales, changes + changes[:9]


def key(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize(("seed", "split"), [(1, 10**9), (2, 1)])
def test_enrich_agrees_with_the_rules(spark, seed, split):
    from vecloom.llm.sale_enrichment import enrich

    sales, changes = shop(seed)
    got = enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame([(*c, "x") for c in changes], CHANGES), group=40, split=split).collect()
    want = brute_enrich(sales, changes)
    assert key(got) == key(want) and {r[2] for r in want if r[0] == "sale"} >= set(range(1, 9)) and any(r[0] == "change" for r in want)


@pytest.mark.parametrize("split", [30, 1000])
@pytest.mark.parametrize("kind", ["microseconds", "years"])
def test_enrich_of_close_and_of_far_times(spark, kind, split):
    """Watermarks that move by less than a millisecond, and in years that nanoseconds don't reach."""
    from vecloom.llm.sale_enrichment import enrich

    rng = random.Random(len(kind))
    sales, changes = [], []
    for i in range(240):
        k = i % 8
        if kind == "microseconds":  # all batches of sales have the same millisecond for their largest time
            base = START + dt.timedelta(days=2)
            sold = base + dt.timedelta(microseconds=rng.choice([rng.randrange(40 * k + 1, 40 * k + 40), -43_200_000_000 + rng.randrange(400)]))
            valid = base + dt.timedelta(hours=12 * rng.randrange(-1, 3), microseconds=rng.randrange(400))
        else:
            sold = dt.datetime(rng.choice([2, 900, 1000 + rng.randrange(100 * k + 1), 1000 + 100 * k, 1700]) if i % 3 or k > 6 else 1000 + 100 * k, 1, 1 + rng.randrange(28), rng.randrange(24))
            sold = min(sold, dt.datetime(1000 + 100 * k, 2, 1) if k < 6 else dt.datetime(9990, 1, 1))
            valid = dt.datetime(rng.choice([1000, 1300, 1600, 1800 + k, 2024, 9000]), 1, 1 + rng.randrange(28), rng.randrange(24))
        sales.append((i, rng.choice([7, 7, 1, 2]), "open", 1.0, sold, START + dt.timedelta(days=19 * k + 1), 1, "r", "b"))
        changes.append((i, rng.choice([7, 7, 1, 2]), i, "U", valid, "web", float(i)))
    for k in range(8):  # later batches of changes too
        changes.append((1000 + k, 1, 0, "U", START + dt.timedelta(days=19 * k + 1), "web", 1.5))
    got = enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame([(*c, "x") for c in changes], CHANGES), group=40, split=split).collect()
    want = brute_enrich(sales, changes)
    assert key(got) == key(want) and len({r[2] for r in want if r[0] == "sale"}) > 2


def test_enrich_of_little(spark):
    """No rows at all; and sales without a single change: nothing is released before the end but what has no time."""
    from vecloom.llm.sale_enrichment import enrich

    no_sales, no_changes = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert enrich(no_sales, no_changes).count() == 0
    sales, _ = shop(3, 30)
    got = enrich(spark.createDataFrame(sales, SALES), no_changes).collect()
    assert key(got) == key(brute_enrich(sales, [])) and all(r.n_held == 0 and r.change_id is None for r in got)
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


# ------------------------------------------------------------------ 12


def tokenizer():
    from tokenizers import Tokenizer

    from vecloom.llm.bpe import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize(("most", "tiers"), [(2048, 4), (64, 1), (64, 7), (8, 3)])
def test_windows_are_full_and_hold_everything(most, tiers):
    from vecloom.llm.tiered_packing import step_groups, windows

    rng = random.Random(most + tiers)
    for n in (1, 2, 30, 200):
        lengths = [rng.choice([1, rng.randint(1, most // 4 + 1), rng.randint(1, most), rng.randint(1, 5 * most), most]) for _ in range(n)]
        found = windows(lengths, most, tiers)
        seen = {}
        for size, own in found:
            assert sum(k for _, _, k in own) == size and size & (size - 1) == 0 and size <= most
            for doc, start, k in own:
                seen.setdefault(doc, []).append((start, k))
        assert sorted(seen) == list(range(n))
        for doc, cut in seen.items():
            at = 0
            for start, k in sorted(cut):
                assert start == at and k > 0
                at += k
            assert at == lengths[doc]
        small = [size for size, _ in found if size < most >> (tiers - 1)]
        assert len(small) == len(set(small))  # one of each at most
        groups = step_groups(found, 4 * most)
        for size in {s for s, _ in found}:
            many = Counter(g for g, (s, _) in zip(groups, found, strict=True) if s == size)
            assert max(many.values()) - min(many.values()) <= 1 and max(many.values()) * size <= 4 * most
    assert windows([], most, tiers) == []


def test_gaps_are_filled_with_whole_documents():
    from vecloom.llm.tiered_packing import windows

    found = windows([40, 24, 33, 20, 11], 64, 2)
    assert sorted(sorted(n for _, _, n in own) for _, own in found) == [[11, 20, 33], [24, 40]]


ODD = [None, "", " \t\n", "a  b\n\n c \t d ", "don't 12 3½ <|endoftext|>x!", "x" * 5000, "é é 漢字　 😀", " a", "word " * 3000, "line\n\nother\r\n" * 900]


def test_tiered_packing(spark):
    from vecloom.llm.tiered_packing import pack

    path, tok = tokenizer()
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choices(["the", "of", "Haus", "rätsel", "\n\n", "x1"], k=rng.randint(1, 900))) for _ in range(60))]
    texts += texts[:12]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string, tier int, offset long")
    rows = pack(df, path, step=1 << 13).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].tier and at & (at - 1) == 0
    assert pack(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        pack(df, path, most=2000)


def test_tokens_of_odd_and_long_texts(monkeypatch):
    """Ids are the library's, also where white space is odd and where texts come in parts."""
    from vecloom.llm import packing

    path, tok = tokenizer()
    rng = random.Random(5)
    bits = ["a", "the", "Word", "don't", "'s", "!!", "é", "　", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "x" * 9, " " * 11, "\x0b", "12", "…", "<|endoftext|>", "<|end"]
    own = packing.Tokens(path, 7)
    for part in (1 << 22, 30):
        monkeypatch.setattr(packing, "PART", part)
        for _ in range(40):
            texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(12)]
            for t, got in zip(texts, own.ids(pa.array(texts)), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 7], repr(t)


# ------------------------------------------------------------------ 13


def brute_phrases(docs, words, least, covered, top):
    import re

    f, n = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        inside = [b for (x, q), b in cands.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in inside):
            continue
        cut = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cut)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, p, x, y in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, x, y, n[lang], -score))
    return rows


@pytest.mark.parametrize(("words", "least", "shard", "bits"), [(3, 4, 1 << 20, 27), (4, 3, 50, 16), (2, 2, 300, 16)])
def test_collocations(spark, words, least, shard, bits):
    from vecloom.llm.phrases import mine

    rng = random.Random(words)
    vocabulary = ["New", "york", "CITY", "of", "the", "is", "été", "x y", "a-b", "東京", "İx"]
    weights = [8, 8, 3, 20, 20, 9, 2, 2, 2, 2, 1]
    docs = []
    for i in range(150):
        t = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for w in rng.choices(vocabulary, weights, k=rng.randint(1, 60)))
        docs.append((t, ["en", "fr", None, "a b"][i % 4]))
    docs += [*docs[:9], (None, "en"), ("", None), ("...", "zz"), ("the of " * 4000, "en"), ("alone", "xx")]
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in docs], "text string, lang string, rank int, phrase string").repartition(5)
    got = mine(df, words, least, 50, 25, bits, shard).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(docs, words, least, 50, 25))


def test_phrases_are_counted_in_two_readings(spark):
    """Texts are not read again for each further automaton of candidates."""
    from vecloom.llm.phrases import mine

    docs = [(" ".join(f"w{i * j % 60}" for j in range(1, 40)) + ".", "en") for i in range(40)] * 2
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    jobs, rows = [], []
    for shard in (1 << 21, 25):
        spark.sparkContext.setJobGroup(f"phrases {shard}", "")
        rows.append(sorted(map(tuple, mine(df, 3, 2, 50, 10**6, shard=shard).collect())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"phrases {shard}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows[0]) > 500 and rows[0] == rows[1]
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("bits", [20, 62])
def test_cells_are_sorted(bits):
    from vecloom.llm.phrases import _sorted

    cell = np.random.default_rng(bits).integers(0, 1 << 12, 5000).astype(np.uint64) << np.uint64(bits - 12)
    order, first = _sorted(cell, bits)
    assert sorted(order.tolist()) == list(range(5000)) and np.array_equal(cell[order], np.sort(cell))
    assert np.array_equal(cell[order][first], np.unique(cell))


def test_collocations_of_nothing(spark):
    from vecloom.llm.phrases import mine

    df = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert mine(df).count() == 0 and mine(df.limit(0)).count() == 0


def test_long_texts_of_phrases_come_in_parts():
    """Parts end where pieces do, and hold the same words and phrases as the whole."""
    from vecloom.llm.phrases import Words, words_of

    text = "".join(f"w{i % 7} x{i % 11} y. " if i % 5 else f"w{i % 7} " for i in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    whole, parts = Words(batch.column("text"), batch.column("lang")), list(words_of(iter([batch]), 500))
    assert len(parts) > 20
    seen = lambda ws: [Counter(k[at].tolist()) for w in ws for _, at, k in w.phrases(3)]
    total = [sum(seen(parts)[i::2], Counter()) for i in (0, 1)]
    assert total == seen([whole]) and sum(len(w.key) for w in parts) == len(whole.key)


# ------------------------------------------------------------------ odd tables


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "meta.url", "a`b", "score", "lang_pred", "Row", "quality", "class", "label"]


def odd_docs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abdeilmnorst", k=rng.randint(2, 8)))
    rows = [(None if i % 13 == 0 else i // 2, " ".join(word() for _ in range(rng.randint(8, 60))), ["aa", "bb", None][i % 3]) for i in range(80)]
    rows += [*rows[:6], (200, None, "aa"), (201, "", None), (202, "word " * 2000, "aa")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, u string, b string, score double, p string, r int, q int, c string, l string"
    return spark.createDataFrame([(i, t, lang, "s", 1, "u", "b", 0.5, "p", 3, 1, "c", "l") for i, t, lang in rows], schema).toDF(*NAMES)


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Clashing and odd names, null and repeated ids, no labels, an empty table: columns stay, rows are the table's."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs(spark)
    whole = Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == NAMES, name
        kept = Counter(tuple(r) for r in out.collect())
        assert not kept - whole and sum(kept.values()) > 40, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


# ------------------------------------------------------------------ 5


def brute_languages(learned, texts):
    """Codewords, weights and losses byte by byte: language, score and margins of each text."""
    from vecloom.llm import language_id as L

    mask = (1 << 32) - 1

    def buckets(text):
        raw = text.encode()
        c = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
        for i, b in enumerate(c):
            if b != 32:
                before, after = c[i - 1] if i else 32, c[i + 1] if i + 1 < len(c) else 32
                code = (before * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask) ^ (after * 0xC2B2AE3D & mask)
                yield ((code ^ (code >> 15)) * 0x2C1B3C6D & mask) >> 18

    counts = {}
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(buckets(text))
    langs = sorted(counts)
    codes = L.codewords(len(langs)).tolist()
    total = {x: sum(counts[x].values()) + L.SMOOTH * L.BUCKETS for x in langs}

    def weight(bucket, bit):
        share = {1: [], -1: []}
        for x, code in zip(langs, codes, strict=True):
            share[code[bit]].append((counts[x][bucket] + L.SMOOTH) / total[x])
        return math.log(sum(share[1]) / len(share[1])) - math.log(sum(share[-1]) / len(share[-1]))

    out = []
    for text in texts:
        own = list(buckets(text or ""))
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        margins = [sum(weight(b, bit) for b in own) / math.sqrt(max(1, len(own))) for bit in range(len(codes[0]))]
        loss = [sum(math.log1p(math.exp(-c * max(-30, min(30, m)))) for c, m in zip(code, margins, strict=True)) / len(code) for code in codes]
        odds = [math.exp(-2 * (x - min(loss))) for x in loss]
        out.append((langs[loss.index(min(loss))], max(odds) / sum(odds)))
    return out


@pytest.mark.parametrize("n", [3, 8])
def test_language_id_agrees_with_decoding_by_hand(spark, n):
    """Languages of shared letters, few rows and a text without any; held-out rows teach nothing."""
    from vecloom.llm.language_id import identify

    rng = random.Random(n)
    kinds = {f"l{k}": ["".join(rng.choices("aeioubdgklmnrstéü", k=rng.randint(2, 6))) for _ in range(25)] for k in range(n)}
    docs = [(i, " ".join(rng.choices(kinds[f"l{i % n}"], k=rng.randint(3, 20))), f"l{i % n}") for i in range(20 * n)]
    docs += [(1000, None, "l0"), (1001, "12 - 3", None), (1002, "ÉÜ Éü", None), (1003, " ".join(kinds["l1"] * 40 + kinds["l2"] * 3), None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    want = brute_languages([(t, lang) for i, t, lang in docs if lang and t is not None and not held(i)], [t for _, t, _ in docs])
    df = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in docs], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in identify(df).collect()}
    for (i, _, _), (lang, score) in zip(docs, want, strict=True):
        assert got[i].held_out == held(i) and got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4)


def test_margins_of_long_texts_come_in_segments(monkeypatch):
    from vecloom.llm import language_id as L

    rng = np.random.default_rng(2)
    model = L.Model(["a", "b", "c"], L.codewords(3), rng.normal(size=(L.BUCKETS, 3)).astype(np.float32), np.full((3, 3), 1 / 3))
    texts = pa.array(["ab cdé " * 300, "", None, "x", "日本 語 abc" * 50])
    whole = model.margins(texts)
    for size in (7, 64, 1001):
        monkeypatch.setattr(L, "SEGMENT", size)
        assert np.allclose(model.margins(texts), whole)


# ------------------------------------------------------------------ 9


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    from vecloom.llm.bpe import Encoder, tokenizer_path

    with pytest.raises(ValueError):
        Encoder(tokenizer_path("byte_bpe_50k.json"))
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            Encoder(str(tmp_path / "t.json"))
