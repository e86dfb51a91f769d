"""The training-data operators against brute force on small tables, with odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clauseflow.llm import fingerprint, jaccard, language, media, mixing, packing, pii, quality, substrings, tokens
from clauseflow.llm.words import Recent, chunks, split_words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size string"


def table(spark, path, rows):
    """A documents table with clashing extra columns; rows: (doc_id, text, lang, source)."""
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "x") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def plain(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "word", None, "b"), (4, "word", None, "b"), (5, "x " * 60_000, "en", "a"), (6, "é😀 ñ", "es", None), (7, "12 + 34", "de", "c"), (8, "\x1c a\x85b 　", "de", "c")]


@pytest.fixture
def odd(spark, tmp_path):
    return table(spark, tmp_path, ODD)


@pytest.fixture
def empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return table(spark, tmp_path, [])


@pytest.mark.parametrize("query", [language.op1_language_id, tokens.op2_token_files, fingerprint.op3_order_minhash, pii.op4_pii, media.op5_media, substrings.op6_substring_dedup, packing.op7_best_fit_packing, jaccard.op8_jaccard_join, quality.op9_quality, mixing.op10_curriculum_mix])
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).collect() == []


def test_words_of_slices_and_caches():
    texts = pa.array([f"Ab é{i}\t x\x0by " * (i % 3) for i in range(3000)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    got = []
    for part in chunks(iter([batch]), rows=700):
        bounds, ids, words = split_words(part.column("text"))
        got += [[words[k] for k in ids[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [WORD.findall(t) for t in texts.to_pylist()]
    cache = Recent(2)
    for k in "abcab":
        _, missing = cache.find([k])
        cache.young.update(dict.fromkeys(missing, 1))
    assert len(cache.young) + len(cache.old) <= 5


def test_language_model_sums_all_segmentations():
    vocab = {"▁a": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5}
    p = np.random.default_rng(0).random((7, 2))

    def total(t):
        if not t:
            return np.ones(2)
        out = 0
        for j in range(1, len(t) + 1):
            if t[:j] in vocab:
                out = out + p[vocab[t[:j]]] * total(t[j:])
            elif j == 1:
                out = out + p[-1] * total(t[1:])
        return out

    words = ["ab", "aab", "cab", "bbbaab"]
    assert np.allclose(language.Lattice.of(words, vocab).likelihood(p), [total("▁" + w) for w in words])


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language.op1_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, tmp_path):
    rows = language.op1_language_id(spark, odd).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [got[i] for i in (1, 2, 3, 7)] == ["und"] * 4 and got[5] != "und" and len(rows) == len(ODD)
    # Numeric signs are no letters; a word of any length is scored; one id for all rows; two languages with the same texts tie.
    rows = [(None, "½ ² ①", "en", "a"), (None, "١٢ ⅷ", "en", "a"), (3, "x" * 30_000, "en", "a"), (3, "same words here", "en", "a"), (3, "same words here", "de", "a"), (3, "same words here", "de", "a"), (9, "ñ", "es", "a")]
    rows = language.op1_language_id(spark, table(spark, tmp_path / "t", rows)).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] is None] == ["und", "und"] and all(r["lang_pred"] != "und" for r in rows if r["doc_id"])


def plain_likelihoods(words, vocab, p):
    """The sum over all segmentations of each word by each language, by plain recursion."""
    from functools import cache

    @cache
    def total(t):
        if not t:
            return np.ones(p.shape[1])
        fits = [(j, vocab[t[:j]]) for j in range(1, len(t) + 1) if vocab.get(t[:j], -1) >= 0]
        if not any(j == 1 for j, _ in fits):
            fits.append((1, -1))
        return sum(p[k] * total(t[j:]) for j, k in fits)

    return {w: total("▁" + w) for w in words}


def test_predictions_against_plain_recursion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    vocab = language.vocabulary(model.path)
    assert max(len(p) for p, i in vocab.items() if i >= 0) > 8
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.op1_language_id(spark, SF).collect()}
    for i, text in plain(spark, SF)[:60]:
        words = re.findall(r"[^\W\d_]+", text.lower())
        known = plain_likelihoods(set(words), vocab, model.probabilities)
        logs = sum(np.log(known[w]) for w in words)
        share = np.exp((logs - logs.max()) / np.sqrt(len(words)))
        assert got[i][0] == model.languages[int(np.argmax(logs))] and abs(got[i][1] - share.max() / share.sum()) < 1e-3


def test_long_words_are_summed_whole():
    vocab = {"▁a": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5, "abbabbab": -1, "abbabbabb": 6} | {"abbabbabb"[:n]: -1 for n in range(3, 9)}
    p = np.random.default_rng(1).random((8, 2)) / 4
    word = "abbabbabb" * 8 + "cab"
    assert np.allclose(language.long_likelihood(word, vocab, np.log(p)), np.log(plain_likelihoods([word], vocab, p)[word]))
    assert np.allclose(np.log(language.Lattice.of([word], vocab).likelihood(p)[0]), language.long_likelihood(word, vocab, np.log(p)))
    uses = np.zeros(8)
    language.long_uses(word, vocab, np.log(p[:, 0]), 2.0, uses)
    assert np.allclose(uses, language.Lattice.of([word], vocab).expected(p[:, :1], np.array([2.0])))
    assert np.isfinite(language.long_likelihood("ab" * 20_000, vocab, np.log(p))).all()


def expected_ids(rows):
    t = tokens._tokenizer(tokens.tokenizer_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for _, x in rows]


def test_token_files_round_trip(spark, odd):
    rows = sorted(plain(spark, odd), key=lambda r: (r[0], r[1] or ""))
    start, want = 0, []
    for (i, _), ids in zip(rows, expected_ids(rows), strict=True):
        ids = np.append(ids, [2]).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.op2_token_files(spark, odd).collect())) == sorted(want)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packed_ids_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_000, dtype=np.uint64).astype("<u4")
    parts = [ids[:0], ids[:7], ids[7:9000], ids[9000:]]
    shard = tokens.Shard(tokens.shard_bytes([None, 1, 2, 3], [p.tobytes() for p in parts], bits, 256))
    assert shard.doc_ids == [None, 1, 2, 3] and all((shard.document(i) == p).all() for i, p in enumerate(parts))
    assert (shard.ids(511, 515) == ids[511:515]).all()


def test_encoder_equals_the_tokenizer():
    texts = ["Don't stop's IT'S <|endoftext|> a<|endoftext|>b", "ΑΣ Σ. İstanbul! ... it's' 12a", "J̌ Á ẞ́ ǅx. ʼn", "<|ENDOFTEXT|> <|EndOfText|>", "", None, "x\x1cy z\x85q"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(tokens.tokenizer_path())(pa.array(texts))]
    assert got == [x.tolist() for x in expected_ids(list(enumerate(texts)))]


def test_encoder_keeps_a_word_once_for_all_its_tails():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    text = "haus haus, haus. haus!) baum baum, 12, 12."
    got = np.frombuffer(encoder(pa.array([text]))[0], "<u4").tolist()
    assert got == expected_ids([(1, text)])[0].tolist()
    assert set(encoder.cache.young) == {"haus", "baum", ",", ".", "!)", "12,", "12."}


def spark_xxhash(*values, seed=42):
    import xxhash

    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True) if not isinstance(v, np.int32) else int(v).to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_signature(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    place, low = fingerprint.PLACE_BITS, (1 << fingerprint.PLACE_BITS) - 1
    hashes = [spark_xxhash(words[i - 1] if i else None, w) for i, w in enumerate(words)]
    seen, held = Counter(), defaultdict(list)
    for i, h in enumerate(hashes):
        kmer = (h & (1 << 64) - 1) >> place
        seen[kmer] += 1
        mixed = (spark_xxhash(kmer, np.int32(seen[kmer] - 1)) & (1 << 64) - 1) & ~low | i
        held[mixed >> 64 - fingerprint.BIN_BITS].append((mixed, i, kmer))
    out = []
    for b, found in held.items():
        value = 0
        for _, _, kmer in sorted(sorted(found)[: fingerprint.TUPLE], key=lambda x: x[1]):
            value = spark_xxhash(kmer, seed=spark_xxhash(value))
        out.append(f"{b << 32 | (value & (1 << 64) - 1) >> 32:010x}")
    return "".join(sorted(out))


def brute_likeness(a, b):
    """The share of bins with equal values, of those that either written signature holds."""
    a, b = (dict((x[i : i + 2], x[i + 2 : i + 10]) for i in range(0, len(x), 10)) for x in (a, b))
    return sum(a.get(k) == b.get(k) for k in {*a, *b}) / len({*a, *b}) if a or b else 1.0


def test_fingerprints(spark, odd, tmp_path):
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=i * 3)), "en", "a") for i in range(1, 30)]
    sf = table(spark, tmp_path / "t", rows)
    for where in (sf, odd):
        docs = sorted(set(plain(spark, where)), key=lambda r: r[0])
        got = {r["doc_id"]: r for r in fingerprint.op3_order_minhash(spark, where).collect()}
        for k, (i, text) in enumerate(docs):
            text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
            q = len(text) // 4
            edited = text[: len(text) - q] + after[:q]
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert got[i]["fingerprint"] == brute_signature(text) and got[i]["edited_fingerprint"] == brute_signature(edited)
            assert abs(got[i]["near_edited"] - brute_likeness(brute_signature(text), brute_signature(edited))) < 1e-9
            assert abs(got[i]["near_next"] - brute_likeness(brute_signature(text), brute_signature(after))) < 1e-9


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, span):
    d = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii_and_redaction(spark, tmp_path):
    draw = random.Random(3)
    bits = ["a.b@c.d", "@", ".", "x", "1.2.3.4", "256.1.1.1", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 123456", "+1", "é", "😀", " ", "-", "5", "99", "DE89370400440532013000", "ssn 123-45-6789", "a@b.c%d@e.f"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 25))), "en", "a") for i in range(400)] + [(900, "1" * 30000 + " " + "a." * 9000 + "@" + "b." * 9000 + "c", None, None), (901, "1 " * 9000, None, None), (902, "1.2.3.4 " * 700, None, None), (903, None, None, None)]
    sf = table(spark, tmp_path, rows)
    got = {r["doc_id"]: r for r in pii.op4_pii(spark, sf).collect()}
    new = {r["doc_id"]: r["text"] for r in pii.redacted(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    kinds = set()
    for i, text, _, _ in rows:
        base = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        assert [s for s in spans if s[0] in PII] == base
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PII] == [sum(s[0] == k for s in base) for k in PII]
        kinds |= {s[0] for s in spans}
        out, at, cuts = [], 0, []
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if cuts and a < cuts[-1][1]:
                cuts[-1][1] = max(b, cuts[-1][1])
            else:
                cuts.append([a, b, k])
        for a, b, k in cuts:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        assert new[i] == (None if text is None else "".join(out) + text[at:])
    assert kinds == {"email", "ip", "card", "phone", "iban", "ssn"}


def test_ibans_beside_capitals_and_digits(spark, tmp_path):
    cases = [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
        ("IBAN GB82 WEST 1234 5698 7654 32 EUR 500", ["GB82 WEST 1234 5698 7654 32"]),
        ("DE89370400440532013000 GB82WEST12345698765432 NO93 8601 1117 947 X", ["DE89370400440532013000", "GB82WEST12345698765432", "NO93 8601 1117 947"]),
        ("é😀 REF AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
        ("BE12 DE89 3704 0044 0532 0130 00 \nMT84 MALT 0110 0001 2345 MTLC AST0 01S", ["DE89 3704 0044 0532 0130 00", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
        ("DE89370400440532013001 DE893704004405320130000 xDE89370400440532013000", []),
        ("GB82 WEST 1234 5698 7654 32 BIC ABCD " * 200, ["GB82 WEST 1234 5698 7654 32"] * 200),
    ]
    sf = table(spark, tmp_path, [(i, text, "en", "a") for i, (text, _) in enumerate(cases)])
    got = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark, sf).collect()}
    for i, (text, want) in enumerate(cases):
        spans = [x.split(":") for x in got[i].split(",") if x.startswith("iban:")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == want
    assert pii.redacted(spark.createDataFrame([(cases[0][0],)], "text string")).first()["text"] == "IBAN [IBAN] BIC COBADEFF"


def test_context_words_raise_scores(spark, tmp_path):
    cases = [
        ("server 1.2.3.4 up", "0.90"), ("ship 1.2.3.4 up", "0.60"), ("1.2.3.4 is the ip", "0.90"), ("the ip is " + "far " * 12 + "1.2.3.4", "0.60"),
        ("write to a@b.cd", "0.90"), ("mail: a@b.cd", "1.00"), ("id 123-45-6789", ""), ("my ssn 123-45-6789", "0.70"), ("lessn 123-45-6789", ""), ("123-45-6789 SSN", "0.70"),
        ("DE89370400440532013000", "0.80"), ("Konto DE89370400440532013000", "1.00"),
    ]
    sf = table(spark, tmp_path, [(i, text, "en", "a") for i, (text, _) in enumerate(cases)] + [(None, "a@b.cd", None, None)] * 2)
    rows = pii.op4_pii(spark, sf).collect()
    assert {r["doc_id"]: r["scores"] for r in rows if r["doc_id"] is not None} == {i: want for i, (_, want) in enumerate(cases)}
    assert [(r["n_email"], r["spans"], r["scores"]) for r in rows if r["doc_id"] is None] == [(1, "email:0:6", "0.90")] * 2
    clash = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as pii", "2 as spans", "3 as whole", "4 as of_ip")
    found = pii.with_spans(clash)
    assert found.columns == [*(c for c in clash.columns if c != "pii"), "pii"] and {r["of_ip"] for r in found.collect()} == {4}


def test_many_spans_cost_in_proportion(spark, tmp_path):
    import time

    n = 40_000
    sf = table(spark, tmp_path, [(1, "1.2.3.4 " * n, "en", "a")])
    pii.op4_pii(spark, table(spark, tmp_path / "w", [(1, "1.2.3.4 " * 10, "en", "a")])).collect()
    start = time.time()
    row = pii.op4_pii(spark, sf).first()
    took = time.time() - start
    assert row["n_ip"] == n and row["base_sha256"] == hashlib.sha256(",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n)).encode()).hexdigest()
    assert took < 10
    assert pii.redacted(spark.read.parquet(f"{sf}/documents.parquet")).first()["text"] == "[IP] " * n


def test_media_round_trip(spark, odd):
    got = {r["doc_id"]: r for r in media.op5_media(spark, odd).collect()}
    for i, text in plain(spark, odd):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.from_png(media.to_png(payload)) == payload
    assert media.op5_media(spark, odd).count() == len(ODD)


def test_interleaved_html(spark):
    html = '<p>Hi <b>you</b></p><script>no</script><figure><img src="sha256:' + "a" * 64 + '" alt="x"><figcaption> A  cat </figcaption></figure>tail<img src="u.png" alt="alt"/>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    rows = {r["page_id"]: r["sequence"] for r in media.interleaved(pages).collect()}
    assert [(x["position"], x["kind"], x["text"], x["caption"]) for x in rows[1]] == [(0, "text", "Hi you", None), (1, "media", "sha256:" + "a" * 64, "A cat"), (2, "text", "tail", None), (3, "media", "u.png", "alt")]
    assert rows[2] == rows[3] == []
    payloads = spark.createDataFrame([("a" * 64, 7)], "digest string, bytes int")
    whole = media.resolved(media.interleaved(pages), payloads, "page_id").collect()
    assert [x["payload"]["bytes"] if x["payload"] else None for x in whole[0]["sequence"]] == [None, 7, None, None]


def test_resolved_keeps_every_row(spark):
    img = lambda c: f'<img src="sha256:{c * 64}">'
    pages = spark.createDataFrame([(1, img("a") + "x", "p"), (1, img("b"), "q"), (None, img("a"), "r"), (None, None, "s"), (3, "", "t"), (4, "<p> </p>", "u")], "page_id long, html string, url string")
    payloads = spark.createDataFrame([("a" * 64, 7), ("b" * 64, 8)], "digest string, bytes int")
    whole = media.resolved(media.interleaved(pages), payloads, "page_id")
    assert whole.columns == ["page_id", "html", "url", "sequence"]
    rows = {r["url"]: r for r in whole.collect()}
    assert {u: (r["page_id"], [x["payload"] and x["payload"]["bytes"] for x in r["sequence"]]) for u, r in rows.items()} == {"p": (1, [7, None]), "q": (1, [8]), "r": (None, [7]), "s": (None, []), "t": (3, []), "u": (4, [])}


def test_documents_stand_in_the_sequences_of_pages(spark, tmp_path, monkeypatch):
    rows = [(i % 40 if i else None, f"text {i % 90} " * (i % 5), "en", "a") for i in range(120)]
    sf = table(spark, tmp_path / "t", rows)
    html = ["<p>one</p><p>two</p>", None, "", '<p>x<template>y<img src="u">', '<img src="sha256:' + "0" * 64 + '" alt="a">z<script>no', "<figure><figcaption>open"]
    spark.createDataFrame([(i, f"http://p/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    own = {i: len(media.sequence_of(h)) for i, h in enumerate(html)}
    assert own == {0: 2, 1: 0, 2: 0, 3: 3, 4: 2, 5: 1}
    for most in (64, 4):
        monkeypatch.setattr(media, "FIGURES", most)
        got = media.op5_media(spark, sf).collect()
        assert sorted((str(r["doc_id"] or ""), r["n_bytes"]) for r in got) == sorted((str(i or ""), len(t)) for i, t, _, _ in rows)
        assert all(r["caption"] == ("" if r["doc_id"] is None else str(r["doc_id"])) for r in got)
        places = Counter((r["page_id"], r["position"]) for r in got)
        assert set(r["page_id"] for r in got) == set(own)
        for page in own:
            seen = sorted(p for i, p in places if i == page)
            assert seen == list(range(own[page], own[page] + len(seen))) and len(seen) <= most
        for r in got:
            text = next(t for i, t, _, _ in rows if (i, len(t)) == (r["doc_id"], r["n_bytes"]) and hashlib.sha256(media.padded(t.encode())).hexdigest() == r["payload_sha256"])
            assert r["payload_bytes"] == len(media.padded(text.encode()))


def test_open_templates_lose_nothing():
    shown = lambda html: [x["text"] for x in media.sequence_of(html)]
    assert shown("a<template>b</template>c<noscript>d<p>e") == ["a", "c", "d", "e"]
    assert shown('a<noscript><figure><img src="u"></noscript>b<template/>c') == ["a", "b", "c"]
    assert shown("a<template>b<template>c</template>d</template>e<script>f") == ["a", "e"]


def test_captions_lose_nothing():
    shown = lambda html: [(x["kind"], x["text"], x["caption"]) for x in media.sequence_of(html)]
    assert shown('<figure><figcaption>first</figcaption><img src="u"></figure>') == [("media", "u", "first")]
    assert shown('<figure><img src="u"><figcaption>open</figure>after') == [("media", "u", "open"), ("text", "after", None)]
    assert shown('<figure><img src="u"><figcaption>open <b>end</b>') == [("media", "u", "open end")]
    assert shown("a<figure><figcaption>alone</figcaption>b</figure>c") == [("text", x, None) for x in ("a", "alone", "b", "c")]
    assert shown("<figcaption>no figure</figcaption>c") == [("text", "no figure", None), ("text", "c", None)]
    assert shown('<figure><figure><img src="u"><figcaption>in</figcaption></figure><img src="v"><figcaption>out</figcaption></figure>') == [("media", "u", "in"), ("media", "v", "out")]


def test_media_query_gives_position_and_caption(spark, odd):
    assert {(r["position"], r["caption"] == str(r["doc_id"])) for r in media.op5_media(spark, odd).collect()} == {(0, True)}


def test_substring_dedup(spark, odd, tmp_path):
    draw = random.Random(5)
    base = [[draw.choice("abcdefgh") + str(draw.randint(0, 40)) for _ in range(200)] for _ in range(4)]
    rows = []
    for _ in range(100):
        words = []
        for _ in range(draw.randint(0, 5)):
            a = draw.randint(0, 150)
            words += draw.choice(base)[a : a + draw.randint(20, 120)] + [str(draw.random())] * draw.randint(0, 1) + ["x"] * (draw.random() < 0.2) * 80
        rows.append((draw.randint(0, 200) if draw.random() < 0.9 else None, " ".join(words) if draw.random() < 0.97 else None, "en", "a"))
    for sf in (table(spark, tmp_path / "t", rows + rows[:5]), odd):
        docs = [(i, WORD.findall(t or "")) for i, t in plain(spark, sf)]
        first = {}
        for i, w in docs:
            for p in range(len(w) - 49 if i is not None else 0):
                key = tuple(w[p : p + 50]) if len(w) < 5000 else ("long",)
                first[key] = min(first.get(key, i), i)
        want = []
        for i, w in docs:
            gone = set()
            for p in range(len(w) - 49 if i is not None and len(w) < 5000 else 0):
                if first[tuple(w[p : p + 50])] < i:
                    gone.update(range(p, p + 50))
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        got = substrings.op6_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[p : p + 3]) for p in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, len(s), least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def test_jaccard_join(spark, odd, tmp_path):
    draw = random.Random(5)
    rows = []
    for _ in range(12):
        base = [draw.choice("abcdefgh") + str(draw.randint(0, 30)) for _ in range(draw.choice([1, 2, 3, 8, 30, 100, 150]))]
        for _ in range(draw.randint(1, 20)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice("xyz") + str(draw.randint(0, 99))
            rows.append((len(rows), " ".join(words).upper() if draw.random() < 0.3 else "\n".join(words), "en", "a"))
    rows += [(None, "only null id here now", None, None), (None, rows[0][1], None, None), (7, rows[7][1], None, None)]
    for sf in (table(spark, tmp_path / "t", rows), odd):
        got = sorted(map(tuple, jaccard.op8_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect()), key=str)
        assert got == brute_components(plain(spark, sf))


def test_packing_is_gapless_and_often_optimal(spark, odd):
    rows = packing.op7_best_fit_packing(spark, odd).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    want = []
    for (i, _), ids in zip(plain(spark, odd), expected_ids(plain(spark, odd)), strict=True):
        ids = np.append(ids, [0]).astype("<u4")
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert len(held) == packing.search(Counter(r["length"] for r in rows)).size


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_search_tries_shorter_fillings_and_says_what_it_proved():
    whole = packing.search(Counter([50, 48, 45, 32, 30, 26, 25, 24, 20]), 100)
    assert (whole.size, whole.proved) == (3, True)
    open_ = packing.search(Counter([50, 48, 45, 32, 30, 26, 25, 24, 20]), 100, steps=1)
    assert (open_.size, open_.bound, open_.proved) == (4, 3, False)
    many = packing.search({50: 10, 48: 10, 45: 10, 32: 10, 30: 10, 26: 10, 25: 10, 24: 10, 20: 10}, 100)
    assert (many.size, many.proved) == (30, True)


def test_sequences_follow_the_order(spark):
    draw = random.Random(2)
    rows = [(i, 0, 0, draw.randint(1, 60), 0, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")
    got = packing.pack(pieces, 100, order=["place"]).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    ranges = min(packing.RANGES, sum(r[3] for r in rows) // (100 * packing.RANGE_SEQUENCES))
    assert ranges > 10 and len(held) <= packing.search(Counter(r[3] for r in rows), 100).size + ranges
    ends = []
    for s in sorted(held):
        at = 0
        for offset, length, _ in sorted(held[s]):
            assert offset == at
            at += length
        assert at <= 100 and max(i for *_, i in held[s]) - min(i for *_, i in held[s]) <= len(rows) // ranges + 1
        ends.append(max(i for *_, i in held[s]) * ranges // len(rows))
    assert ends == sorted(ends)


def test_bin_completion_finds_the_optimum():
    better = 0
    for s in range(120):
        draw = random.Random(s)
        capacity = draw.choice([20, 50, 100])
        counts = Counter(draw.randint(max(1, capacity // 6), capacity // 2) for _ in range(draw.randint(1, 12)))
        found = packing.bin_completion(counts, capacity)
        placed = Counter()
        for pattern, times in found:
            assert sum(n * k for n, k in pattern) <= capacity
            placed.update({n: k * times for n, k in pattern})
        assert placed == counts
        size = sum(t for _, t in found)
        assert packing.search(counts, capacity).proved and packing.lower_bound(counts, capacity) <= size
        assert size == optimum(list(counts.elements()), capacity)
        better += size < sum(t for _, t in packing.best_fit_decreasing(counts, capacity))
    assert better


def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op9_quality(spark, SF).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def plain_scores(model, texts):
    """The model's scores by plain loops over each text's words."""
    out = []
    for text in texts:
        words = [w for raw in WORD.findall(text or "") for w in quality.WORD.findall(raw)]
        rows = [model.vectors.vectors[model.vectors.words[w]].astype(float) if w in model.vectors.words else np.zeros(quality.DIMENSIONS) for w in words]
        mean = sum(rows) / len(rows) if rows else np.zeros(quality.DIMENSIONS)
        pairs = sum(a * b for a, b in zip(rows, rows[1:], strict=False)) / (len(rows) - 1) if len(rows) > 1 else np.zeros(quality.DIMENSIONS)
        w1, b1, w2, b2 = model.layers
        x = (np.concatenate([mean, pairs]) - model.shift) / model.scale
        out.append(1 / (1 + np.exp(-np.clip(float((np.maximum(x @ w1 + b1, 0) @ w2 + b2)[0]) / model.temperature, -60, 60))))
    return out


def test_word_vectors_and_scores_against_plain_loops(spark, monkeypatch):
    texts = ["Ab cd*** Ab\u00a0x cd", "", "a_b __ ab", "Ab Ab Ab", None]
    vectors = quality.WordVectors.learn([t or "" for t in texts])
    index = {}
    for w in vectors.words:
        places, signs = quality.index_vectors([w])
        index[w] = np.bincount(places[0], signs[0], quality.DIMENSIONS)
        assert np.count_nonzero(index[w]) == quality.NONZERO
    for w, k in vectors.words.items():
        want = np.zeros(quality.DIMENSIONS)
        for text in texts:
            words = [x for raw in WORD.findall(text or "") for x in quality.WORD.findall(raw)]
            for i, x in enumerate(words):
                for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                    if x == w:
                        want += np.roll(index[words[j]], j - i)
        assert np.allclose(vectors.vectors[k], want / np.linalg.norm(want), atol=1e-5)
    model = quality.fit_rows(["good words here", "bad!!! bad!!! bad!!!"] * 20, np.array([1.0, 0.0] * 20), np.ones(40), np.arange(40) % 5 == 0)
    monkeypatch.setattr(quality, "BLOCK", 4)
    long = "good bad!!! here " * 50
    got = model.scores(quality.Pooler(model.vectors)(pa.array([*texts, long], pa.large_string())).astype(float))
    assert np.allclose(got, plain_scores(model, [*texts, long]), atol=1e-4)


def test_quality_sample_is_bounded(spark, tmp_path, monkeypatch):
    rows = [(i % 7, f"text {i} of many", "en", "a") for i in range(300)] + [(1, "long " * 9000, "en", "a")]
    docs = spark.read.parquet(f"{table(spark, tmp_path / 't', rows)}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3 + [(1, 0), (2, 9), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda texts, y, of_class, apart: seen.append((texts, y.tolist())))
    quality.fit(docs, labels, sample_rows=20)
    assert Counter(seen[0][1]) == {0.0: 20, 1.0: 20} and max(map(len, seen[0][0])) < 100


def test_quality_learns_from_one_class_only(spark, odd):
    spark.createDataFrame([(4, 1), (5, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{odd}/labels.parquet")
    rows = quality.op9_quality(spark, odd).collect()
    assert len(rows) == len(ODD) and all(r["score"] > 0.9 for r in rows)


def brute_targets(sizes, weights, cap):
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = sum(sizes) - sum(targets[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share[i]
            break
        for i in over:
            targets[i] = cap * sizes[i]
            free.remove(i)
    return targets


def brute_mix(rows, targets, seed=17):
    """{source: [(doc_id, size, taken)]} and the words taken: rows are (doc_id, source, size), one after the other."""
    out = {}
    for name, target in targets.items():
        own = [(i, n) for i, s, n in rows if s == name]
        whole = sum(n for _, n in own)
        full, part = (int(target // whole), target / whole % 1.0) if whole else (0, 0.0)
        hashed = lambda x: spark_xxhash(np.int32(seed), x[0], x[1])
        order = lambda x: ((hashed(x) >> 7) % 16, hashed(x), x[0] is not None, x)
        classes = defaultdict(list)
        for x in own:
            if x[1]:
                classes[(x[1].bit_length() - 1) // mixing.CLASS_BITS].append(x)
        due, found = 0.0, [(i, 0, 0) for i, n in own if not n]
        for c in sorted(classes, reverse=True):
            wanted, at, took = (due + part * sum(n for _, n in classes[c]) if part else 0.0), 0, 0
            for i, n in sorted(classes[c], key=order):
                more = at + n / 2 <= wanted
                at += n
                took = at if more else took
                found.append((i, n, n * min(3, full + more)))
            due = wanted - took
        out[name] = sorted(found, key=str)
    return out


def targets_of(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    return dict(zip(names, brute_targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], 3), strict=True))


def test_mix(spark, odd, tmp_path):
    draw = random.Random(4)
    words = lambda n: " ".join(["w"] * n)
    alike = [(7, words(300), "en", "a")] * 3 + [(i, words(draw.randint(1, 40)), "en", "a") for i in range(20, 60)]
    alike += [(i, words(draw.choice([0, 1, 5, 30, 200, 5000])), "en", draw.choice("bcd")) for i in range(100, 160)]
    for sf in (SF, odd, table(spark, tmp_path / "t", alike)):
        rows = mixing.op10_curriculum_mix(spark, sf).collect()
        docs = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
        sizes = defaultdict(int)
        for _, s, n in docs:
            sizes[s] += n
        targets = targets_of(sizes)
        found = brute_mix(docs, targets)
        want = [(i, n, sizes[s], taken) for s, own in found.items() for i, n, taken in own]
        assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in rows), key=str) == sorted(want, key=str)
        assert {(r["source_size"], round(r["target"], 3)) for r in rows} == {(sizes[s], round(t, 3)) for s, t in targets.items()}
        for s, own in found.items():
            missed = abs(sum(t for *_, t in own) - targets[s])
            assert missed <= max((n for _, n, _ in own), default=0) / 2 + 1e-6 and (sf != SF or missed <= 0.06 * targets[s])
        copies = sorted((p, k) for r in rows for p, k in zip(r["positions"], r["ranks"], strict=True))
        assert [k for _, k in copies] == list(range(len(copies))) and all(len(r["ranks"]) == (r["taken"] // r["size"] if r["size"] else 0) for r in rows)
        again = mixing.op10_curriculum_mix(spark, sf).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))


def test_alike_rows_are_counted_one_by_one(spark, tmp_path):
    words = lambda n: " ".join(["w"] * n)
    sf = table(spark, tmp_path / "t", [(1, words(300), "en", "a")] * 3 + [(2, words(3000), "en", "b"), (3, words(700), "en", "a")])
    rows = mixing.op10_curriculum_mix(spark, sf).collect()
    taken = sum(r["taken"] for r in rows if r["source_size"] == 1600)
    assert abs(taken - next(r["target"] for r in rows if r["source_size"] == 1600)) <= 150
    order = mixing.training_order(spark.read.parquet(f"{sf}/documents.parquet"))
    assert Counter(r["doc_id"] for r in order.collect()) == Counter(r["doc_id"] for r in rows for _ in r["ranks"])


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for schedule in mixing.SCHEDULES:
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.time_due(F.lit(share), schedule).alias("t")).first()["t"]
            grid = np.linspace(0, 1, 20_001)
            weight = np.interp(grid, *zip(*schedule, strict=True))
            due = np.interp(t, grid, np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / np.sum((weight[1:] + weight[:-1]) / 2))
            assert abs(due - share) < 1e-3
