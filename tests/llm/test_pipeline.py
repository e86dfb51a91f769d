"""The corpus pipeline, stage by stage, on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from clauseflow.llm import pii, tokens
from test_operators import PII, SF, WORD, passes, plain, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, sf, tmp_path):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    known, alone, clean, mixed, packed = staged(spark, SF, tmp_path)
    assert [d.columns for d in (known, alone, clean, mixed)] == [COLUMNS] * 4
    assert known.count() == whole.count()  # all documents there have a language
    rows = plain_rows(known)
    expected = five_word_components(rows)
    assert {r["doc_id"] for r in alone.collect()} == expected and alone.count() == len(expected)
    for r in clean.collect():
        assert not any(passes(k, m.group()) for k, p in PII.items() for m in re.finditer(p, r["text"]))
        assert r["n_chars"] == len(r["text"])
    found = [r["doc_id"] for r in mixed.collect()]
    assert set(found) <= expected and max(Counter(found).values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    times, t = Counter(found), tokens._tokenizer(tokens.tokenizer_path())
    want = Counter()
    for i, text in texts.items():
        ids = np.append(np.array(t.encode(text, add_special_tokens=False).ids, "<u4"), [0]).astype("<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[i, p, zlib.crc32(ids[s : s + 2048].tobytes())] += times[i]
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()) == want
    held = defaultdict(list)
    for r in packed.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)][:-1]]).tolist()
    assert sorted(map(str, packed.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def plain_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "12 34", "en", "a"), (4, "one two three four", "en", "a"), (4, "one two three four", "en", "a"), (5, "mail a@b.cd now please", "en", "b"), (6, "One two three four", None, "b"), (None, "la vie est belle", "fr", None)]
    sf = table(spark, tmp_path / "t", rows)
    clash = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("_id", "_h", "_n", "position", "positions", "plan_id", "_lang", "_score", "_pii", "_blocks", "score", "passes", "component_id"):
        clash = clash.selectExpr("*", f"'kept' as `{name}`")
    clash.write.mode("overwrite").parquet(f"{tmp_path}/c/documents.parquet")
    out = staged(spark, f"{tmp_path}/c", tmp_path)
    assert all(d.columns == clash.columns for d in out[:4]) and {r["_id"] for r in out[3].collect()} <= {"kept"}
    assert {r["doc_id"] for r in out[0].collect()} == {4, 5, 6, None} and sorted(str(r["doc_id"]) for r in out[1].collect()) == ["4", "5", "None"]
    assert [r["text"] for r in out[2].collect() if r["doc_id"] == 5] == ["mail [EMAIL] now please"]
    assert pii.redacted(clash).columns == clash.columns


def test_empty_table(spark, tmp_path):
    sf = table(spark, tmp_path / "t", [])
    assert all(d.isEmpty() for d in staged(spark, sf, tmp_path)) and corpus_pipeline.run(spark, sf).isEmpty()
    assert plain(spark, sf) == []


def five_word_components(rows):
    """The least id of each document's component by links of 5-word Jaccard similarity 0.8, one pair at a time."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return set(least.values())


def test_near_copies_by_five_words(spark, tmp_path):
    draw = random.Random(11)
    rows = []
    for size in (3, 4, 5, 6, 30, 60, 100, 150, 200):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(size)]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(changes):
                words[draw.randrange(size)] = f"x{draw.randint(0, 5000)}"
            rows.append((len(rows), " ".join(words), "en", "a"))
    # One changed word of 50: 3-word similarity 45/51, 5-word 41/51; both below 0.9, the second at least 0.8.
    one = [f"v{i}" for i in range(50)]
    rows += [(900, " ".join(one), "en", "a"), (901, " ".join([*one[:25], "other", *one[26:]]), "en", "a")]
    sf = table(spark, tmp_path / "t", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == five_word_components(plain(spark, sf))
    assert 900 in kept and 901 not in kept


def test_rows_are_found_in_the_order_they_were_written(spark, tmp_path):
    from clauseflow.llm.common import placed

    spark.range(3000).repartitionByRange(12, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    for frame in (spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/t").withColumnRenamed("id", "_metadata")):
        place = placed(frame)
        rows = place.frame.select(place.frame.columns[0], place.column.alias("place")).collect()
        assert len({tuple(r["place"]) for r in rows}) == 3000
    place = placed(spark.read.parquet(f"{tmp_path}/t"))
    assert [r["id"] for r in place.frame.select("id", place.column.alias("place")).orderBy("place").collect()] == list(range(3000))
