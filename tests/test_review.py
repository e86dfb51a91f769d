import random

from clauseflow.operators import retrieval, review, segment, transport
from clauseflow.operators.fold import packed_by_budget
from clauseflow.plans import loop

CANDIDATE = "contract_id string, candidate_id string, seq int, code string, severity string, message string, clause_ids array<string>, block_ids array<string>, evidence array<string>, confidence double, source string"


def test_candidate_merge_equals_plain_python(spark):
    random.seed(3)
    rows = []
    for c in "ab":
        for i in range(40):
            rows.append((c, f"K{i:03d}", i, random.choice(["x", "y"]), random.choice(["high", "medium", "low"]), f"m{i}", random.sample(["1", "2", "3", "4", "5", "6"], random.randint(0, 2)), [], [f"e{i % 5}"], random.choice([0.5, 0.8]), random.choice(["p", "q"])))
    expected = []
    for c in "ab":
        held = []
        for r in (dict(zip(["c", "id", "seq", "code", "sev", "msg", "cl", "bl", "ev", "conf", "src"], r, strict=True)) for r in rows if r[0] == c):
            r["cl"], r["ev"] = list(r["cl"]), list(r["ev"])
            t = next((h for h in held if h["code"] == r["code"] and (not h["cl"] or not r["cl"] or set(h["cl"]) & set(r["cl"]))), None)
            if t is None:
                held.append(r)
                continue
            if r["conf"] > t["conf"]:
                t.update(conf=r["conf"], sev=r["sev"], msg=r["msg"])
            if r["src"] not in t["src"]:
                t["src"] += "+" + r["src"]
            t["ev"] += [e for e in r["ev"] if e not in t["ev"]]
            t["cl"] += [x for x in r["cl"] if x not in t["cl"]]
        expected += [(h["id"], h["sev"], h["msg"], h["cl"], h["ev"], h["conf"], h["src"]) for h in held]
    got = review.merge_candidates(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert sorted(map(str, expected)) == sorted(str((r["candidate_id"], r["severity"], r["message"], r["clause_ids"], r["evidence"], r["confidence"], r["source"])) for r in got)


def test_guardrails(spark):
    rows = [("a", f"K{i}", i, "zero_rent", "low", f"m{i}", ["C1"], [], ["e"], 0.8, "p+q") for i in range(5)]
    candidates = spark.createDataFrame(rows, CANDIDATE)
    decisions = spark.createDataFrame([("a", "K1", False, "", False, "r"), ("a", "K2", False, "high", False, "r"), ("a", "K3", True, "", False, "r"), ("a", "K4", True, "", False, "r")], "contract_id string, candidate_id string, keep boolean, severity string, review_required boolean, rationale string")
    said = [("a", "K1", "no_substantive_risk", ""), ("a", "K2", "legal_risk", "why"), ("a", "K3", "insufficient_facts", ""), ("a", "K4", "legal_risk", "")]
    applied = spark.createDataFrame(said, "contract_id string, candidate_id string, assessment string, reason string").selectExpr("*", f"cast(null as {review.CITATION}) as citation")
    got = {r["candidate_id"]: r for r in review.adjudicate(candidates, decisions, applied).collect()}
    assert set(got) == {"K0", "K2", "K3", "K4"}
    assert (got["K0"]["confidence"], got["K0"]["review_required"], got["K0"]["category"]) == (0.5, True, "unassessed")
    assert got["K2"]["review_required"] and got["K2"]["severity"] == "high" and got["K2"]["message"] == "why" and "护栏" in got["K2"]["rationale"]
    assert got["K3"]["review_required"] and not got["K4"]["review_required"]
    assert [r["agent_sources"] for r in got.values()] == [["p", "q"]] * 4
    assert review.feedback(candidates, applied).count() == 1
    assert {r["confidence"] for r in review.fallback(candidates).collect()} == {0.5}


def test_fusion_and_queue(spark):
    rows = [("a", "K0", 0, "zero_rent", "low", "m", ["C1"], [], ["e"], 0.8, "p"), ("a", "K1", 1, "zero_rent", "high", "m", ["C1", "C2"], [], ["f"], 0.8, "q"), ("a", "K2", 2, "x", "medium", "m", ["C3"], [], [], 0.8, "q")]
    risks = review.fallback(spark.createDataFrame(rows, CANDIDATE))
    sig = spark.createDataFrame([("a", "amount", "n", "C2", ""), ("a", "date", "n", "C9", ""), ("a", "completeness", "n", "", "")], "contract_id string, kind string, note string, clause_id string, value string")
    fused = review.fuse(risks, sig).orderBy("seq").collect()
    assert [(r["risk_id"], r["code"], r["severity"], r["clause_ids"], r["confidence"], r["cross_validated"]) for r in fused] == [("R0001", "zero_rent", "high", ["C1", "C2"], 0.6, True), ("R0002", "x", "medium", ["C3"], 0.5, False)]
    queue = sorted(r["code"] for r in review.review_queue(review.fuse(risks, sig), sig).collect())
    assert queue == ["element_signal:completeness", "element_signal:date", "x", "zero_rent"]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("a", "定金不得超过百分之二十"), ("b", "租赁期限不得超过二十年"), ("c", "当事人协商一致")], "id string, text string")
    index = retrieval.postings(docs)
    queries = spark.createDataFrame([("q", "定金超过百分之二十"), ("none", "xyz")], "query_id string, text string")
    hits = retrieval.sparse_topk(index, queries).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in hits][:2] == [("q", "a"), ("q", "b")] and all(r["query_id"] == "q" for r in hits)
    legs = [spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)], "query_id string, id string, rank int") for ids in ("abc", "bad")]
    assert [r["id"] for r in retrieval.fuse(*legs).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_filter_keeps_the_weights_of_the_whole_corpus(spark):
    docs = spark.createDataFrame([("a", "定金不得超过百分之二十", ["x"]), ("b", "租赁期限不得超过二十年", ["y"]), ("c", "定金协商一致", ["y"])], "id string, text string, contract_types array<string>")
    queries = spark.createDataFrame([("q", "定金超过百分之二十")], "query_id string, text string")
    index, among = retrieval.postings(docs.select("id", "text")), retrieval.allowed(docs, ["y"])
    whole = {r["id"]: r["score"] for r in retrieval.sparse_topk(index, queries).collect()}
    found = retrieval.sparse_topk(index, queries, 2, among=among).orderBy("rank").collect()
    assert {r["id"]: r["score"] for r in found} == {i: whole[i] for i in "bc"} and [r["rank"] for r in found] == [1, 2]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert {r["id"] for r in retrieval.hybrid(index, vectors, queries, asked, among=among).collect()} == {"b", "c"}


def test_judge_is_asked_again_by_contract(spark):
    import json

    block = "array<string>"
    tree = spark.createDataFrame([(c, 1, "C0001", "一", "", "付款", "甲方应付款。", 1, None, ["B0001"]) for c in ("good", "late", "bad")], f"contract_id string, clause_seq int, clause_id string, label string, title string, heading string, text string, level int, parent_id string, block_ids {block}")
    risk = json.dumps({"risks": [{"code": "zero_rent", "severity": "high", "clause_id": "C0001", "reason": "r", "evidence": "e"}]})
    heard = json.dumps({"verdicts": [{"candidate_id": "KC0001", "keep": True, "severity": "low", "review_required": False, "rationale": "why"}], "overall_assessment": "high_risk", "overall_score": 40})
    turns = []

    def ask(schema, rows):
        ids = sorted(r[0] for r in rows.select("contract_id").distinct().collect())
        if schema == "final_adjudication":
            turns.append(ids)
            said = [(c, 0, heard if c == "good" and len(turns) == 1 or c == "late" and len(turns) == 2 else None) for c in ids]
        else:
            said = [(c, 0, risk if schema == "clause_risk_review" else None) for c in ids]
        return spark.createDataFrame(said, "contract_id string, batch int, response string")

    def search(queries):
        return spark.createDataFrame([], "contract_id string, candidate_id string, article_uid string, law_name string, article_no string, source_url string")

    done = loop.run_review(tree, ask, search)
    assert turns == [["bad", "good", "late"], ["bad", "late"]] and done.counters["judge_retries"] == 2
    assert {r["contract_id"]: r["confidence"] for r in done.risks.collect()} == {"good": 0.9, "late": 0.9, "bad": 0.5}
    assert {r["contract_id"]: r["overall_assessment"] for r in done.overall.collect()} == {"good": "high_risk", "late": "high_risk", "bad": "unknown"}


def test_tags(spark):
    old = spark.createDataFrame([("1", ["a", "b", "b"]), ("2", None)], "u string, tags array<string>")
    new = spark.createDataFrame([("1", ["b", "c"])], "u string, tags array<string>")
    assert {r["u"]: r["tags"] for r in retrieval.merge_tags(old, new, "u", ("tags",)).collect()} == {"1": ["b", "c", "a"], "2": []}


def test_segments_cover_every_block(spark):
    six = spark.createDataFrame([("k", i, b, int(i > 3)) for i, b in enumerate("abcdef", 1)], "contract_id string, seq int, block_id string, batch int")
    said = spark.createDataFrame([("k", 0, '{"clauses": [{"block_ids": ["b", "zz"]}]}'), ("k", 1, '{"clauses": [{"block_ids": ["e", "b"]}]}')], "contract_id string, batch int, response string")
    rows = segment.segments(six, said).orderBy("segment", "place").collect()
    assert [[r["block_id"] for r in rows if r["segment"] == s] for s in (1, 2, 3)] == [["a"], ["b", "c", "d"], ["e", "f"]]
    assert segment.cut_batches([5, 5, 5, 5], [True, False, True, False], 3, 100) == [0, 0, 1, 1]
    assert packed_by_budget([4, 4, 9, 1], 8) == [0, 0, 1, 2]
    blocks = spark.createDataFrame([("k", i, f"B{i}", 0) for i in range(1, 6)], "contract_id string, seq int, block_id string, batch int")
    answer = '{"clauses": [{"label": "一", "title": "t", "level": 9, "block_ids": ["B2", "B3"], "confidence": 2}, {"label": "", "title": "", "level": 3, "block_ids": ["B5", "B3"]}]}'
    found = segment.segments(blocks, spark.createDataFrame([("k", 0, answer)], "contract_id string, batch int, response string"))
    assert [(r["segment"], r["block_id"], r["level"]) for r in found.orderBy("segment", "seq").collect()] == [(1, "B1", 2), (2, "B2", 6), (2, "B3", 6), (2, "B4", 6), (3, "B5", 3)]
    assert [r["relation"] for r in segment.boundaries_of(found).orderBy("seq").collect()] == ["NEW_SUBCLAUSE", "SAME_CLAUSE", "SAME_CLAUSE", "NEW_SUBCLAUSE"]


def test_transport_keeps_errors_as_rows(spark):
    def fake(prompt, schema):
        if "bad" in prompt:
            raise ValueError("no")
        return '```json\n{"x": 1}\n```'

    asked = transport.ask(spark.createDataFrame([("1", "good"), ("2", "bad")], "request_id string, prompt string"), "s", fake)
    rows = {r["request_id"]: r for r in asked.withColumn("json", transport.json_text(asked["response"])).collect()}
    assert rows["1"]["json"] == '{"x": 1}' and rows["2"]["response"] is None and "ValueError" in rows["2"]["error"]
    texts = spark.createDataFrame([(1, "甲"), (2, None)], "id long, text string")
    assert [len(r["embedding"]) for r in transport.embedded(texts, transport.hash_embedding).collect()] == [64, 64]


def split_answers(spark, replies):
    """An asker that answers each contract's split requests in turn; None fails."""
    import json

    turns = []

    def ask(schema, requests):
        rows = requests.collect()
        turns.append(sorted((r["contract_id"], r["batch"]) for r in rows))
        said = [(r["contract_id"], r["batch"], None if (x := replies[r["contract_id"]].pop(0)) is None else json.dumps({"clauses": x})) for r in sorted(rows, key=lambda r: (r["contract_id"], r["batch"]))]
        return spark.createDataFrame(said, "contract_id string, batch int, response string")

    return ask, turns


def item(label, ids, level=2, sure=0.95, title=""):
    return {"label": label, "title": title, "level": level, "block_ids": ids, "confidence": sure}


def test_split_asks_again_about_damaged_windows_only(spark):
    from pyspark.sql import functions as F

    from clauseflow.operators import structure

    lines = ["第一条 甲", "一二三", "第二条 乙", "四五六"]
    rows = [(c, i, "paragraph", t) for c in ("better", "worse", "fails", "fine", "broken") for i, t in enumerate(lines, 1)]
    blocks, decided, _ = structure.analyze(spark.createDataFrame(rows, "contract_id string, seq int, kind string, text string"))
    good = [item("第一条", ["B0001", "B0002"], title="甲"), item("第二条", ["B0003", "B0004"])]
    low = [item("第一条", ["B0001", "B0002"]), item("第二条", ["B0003", "B0004"], sure=0.3)]
    ask, turns = split_answers(spark, {"better": [low, [item("第二条", ["B0003"]), item("（一）", ["B0004"], 3)]], "worse": [low, [item("第一条", ["B0001", "B0002"]), item("第二条", ["B0003", "B0004"], sure=0.2)]], "fails": [low, None], "fine": [good], "broken": [None]})
    done = segment.split_contracts(blocks, decided, ask)
    assert turns == [[(c, 0) for c in ("better", "broken", "fails", "fine", "worse")], [(c, 1) for c in ("better", "fails", "worse")]]
    summary = {r["contract_id"]: (r["succeeded"], r["issues_before"], r["issues_after"], r["rounds"], r["reflowed"], r["adopted"]) for r in done.summary.collect()}
    assert summary == {"better": (1, 1, 0, 1, 4, 1), "worse": (1, 1, 1, 1, 4, 0), "fails": (1, 1, 1, 0, 0, 0), "fine": (1, 0, 0, 0, 0, 0), "broken": (0, 0, 0, 0, 0, 0)}
    tree = {}
    for r in done.clauses.orderBy("clause_seq").collect():
        tree.setdefault(r["contract_id"], []).append((r["label"], r["level"], r["heading"], r["body"]))
    assert tree["fine"] == [("第一条", 2, "第一条 甲", "一二三"), ("第二条", 2, "第二条", "乙\n四五六")]
    assert [x[0] for x in tree["better"]] == ["第二条", "（一）"] and "broken" not in tree
    covered = done.segments.groupBy("contract_id").agg(F.sort_array(F.collect_list("block_id")).alias("b")).collect()
    assert all(r["b"] == ["B0001", "B0002", "B0003", "B0004"] for r in covered) and len(covered) == 4


def test_window_answers_keep_every_block(spark):
    rows = [("k", 5, i, i, f"B{i}", "t", "", "", 2, 0.5, 5) for i in range(1, 6)]
    shown = spark.createDataFrame(rows, "contract_id string, segment int, place int, seq int, block_id string, text string, label string, title string, level int, confidence double, batch int")
    for answer, want in (([item("x", ["B4", "B2"]), item("y", ["B2", "B5"])], [0, 0, 0, 0, 1]), ([], [-1] * 5), ([item("x", ["zz"])], [-1] * 5), ([item("x", ["B3"]), item("y", ["B2"])], [0, 1, 0, 0, 0])):
        ask, _ = split_answers(spark, {"k": [answer]})
        found = segment.window_segments(shown, ask("s", spark.createDataFrame([("k", 5)], "contract_id string, batch int"))).orderBy("seq").collect()
        assert [r["item"] for r in found] == want


def test_boundary_answers(spark):
    import json

    from clauseflow.operators import structure

    rows = [("k", i, "paragraph", t) for i, t in enumerate(["甲", "乙", "丙", "丁", "戊", "己", "庚"], 1)]
    blocks, decided, _ = structure.analyze(spark.createDataFrame(rows, "contract_id string, seq int, kind string, text string"))
    said = [
        ("D0001", "NEW_CLAUSE", 0.99, "TITLE"), ("D0001", "SAME_CLAUSE", 0.99, "BODY"), ("D0002", "NEW_CLAUSE", 0.7, "BODY"), ("D0003", "NEW_CLAUSE", 0.5, "BODY"),
        ("D0004", "NEW_CLAUSE", 0.9, "HEADLINE"), ("D0005", "OTHER", 0.9, "BODY"), ("D0099", "NEW_CLAUSE", 0.9, "BODY"),
    ]
    reply = json.dumps({"boundaries": [{"boundary_id": b, "relation": r, "confidence": c, "right_block_role": role, "inferred_title": "", "reason": "why"} for b, r, c, role in said]})

    def ask(schema, requests):
        assert requests.count() == 1 and "D0006" in requests.first()["prompt"]
        return spark.createDataFrame([("k", 0, reply)], "contract_id string, batch int, response string")

    changed, tree, summary = segment.review_boundaries(blocks, decided, ask, "m")
    got = {r["boundary_id"]: (r["relation"], r["confidence"], r["decision_source"], r["review_required"]) for r in changed.collect()}
    assert got["D0001"] == ("NEW_CLAUSE", 0.95, "llm:m", False) and got["D0002"] == ("NEW_CLAUSE", 0.7, "llm:m", True)
    assert got["D0003"] == ("SAME_CLAUSE", 0.42, "llm_unresolved:m", True)
    assert got["D0004"] == got["D0005"] == got["D0006"] == ("SAME_CLAUSE", 0.42, "default_rule", True)
    warnings = {r["boundary_id"]: r["warnings"] for r in changed.collect()}
    assert warnings["D0001"] == [] and len(warnings["D0003"]) == 2 and len(warnings["D0004"]) == 1
    assert summary.first().asDict() == {"contract_id": "k", "requested": 6, "batches": 1, "failed": 0, "responded": 5, "accepted": 1, "unresolved": 5}
    assert [r["label"] for r in tree.orderBy("clause_seq").collect()] == ["前言", "未编号", "未编号"]
    far = spark.createDataFrame([("k", s, True) for s in (2, 10, 21, 22, 60)], "contract_id string, seq int, review_required boolean")
    many = spark.createDataFrame([("k", s) for s in range(1, 61)], "contract_id string, seq int")
    assert [(r["seq"], r["batch"], r["begin"], r["end"]) for r in segment.target_batches(far, many).orderBy("seq").collect()] == [(2, 0, 1, 12), (10, 0, 1, 12), (21, 1, 19, 24), (22, 1, 19, 24), (60, 2, 58, 60)]


def test_warnings_are_refreshed(spark):
    old = spark.createDataFrame([("k", ["[结构校验] x", "3处等待语义模型或人工复核", "未识别到明确的条款编号。", "留下"])], "contract_id string, warnings array<string>")
    tree = spark.createDataFrame([("k", 1), ("k", 2)], "contract_id string, clause_seq int")
    found = spark.createDataFrame([("k", "duplicate_label")], "contract_id string, code string")
    assert segment.refreshed_warnings(old, tree, found).first()["warnings"] == ["留下", "[结构校验] duplicate_label"]
    assert segment.refreshed_warnings(old, tree.limit(1), found.limit(0)).first()["warnings"] == ["未识别到明确的条款编号。", "留下"]


def reviewed(spark, script, texts=("付款",), limits=None):
    """run_review over contracts with scripted answers: {contract: {schema: [answer, ...]}}; the last answer goes on, a
    missing schema fails. Returns the review and the calls by schema."""
    import json
    from collections import defaultdict

    rows = [(c, i, f"C{i:04d}", f"第{i}条", "", "", t, 2, None, [f"B{i:04d}"]) for c in script for i, t in enumerate(texts, 1)]
    tree = spark.createDataFrame(rows, "contract_id string, clause_seq int, clause_id string, label string, title string, heading string, text string, level int, parent_id string, block_ids array<string>")
    calls = defaultdict(list)

    def ask(schema, requests):
        out = []
        for r in requests.collect():
            assert "prompt" in requests.columns and r["prompt"]
            calls[schema].append(r["contract_id"])
            left = script[r["contract_id"]].get(schema, [None])
            answer = left.pop(0) if len(left) > 1 else left[0]
            out.append((r["contract_id"], r["batch"], None if answer is None else json.dumps(answer)))
        return spark.createDataFrame(out, "contract_id string, batch int, response string")

    def search(queries):
        found = queries.selectExpr("contract_id", "candidate_id", "'a1' as article_uid", "'民法典' as law_name", "'第一条' as article_no", "cast(null as string) as source_url")
        return found

    return loop.run_review(tree, ask, search, limits), calls


def clause_risk(code="unfair_term", severity="high"):
    return {"risks": [{"code": code, "severity": severity, "clause_id": "C0001", "reason": "r", "evidence": "e"}, {"code": code, "severity": severity, "clause_id": "C9", "reason": "", "evidence": ""}]}


def verdict(assessment="legal_risk", uid="a1"):
    return {"verdicts": [{"candidate_id": "KC0001", "assessment": assessment, "severity": "high", "reason": "违反。", "article_uid": uid, "quote": "。"}]}


def ruling(score, keep=True):
    return {"verdicts": [{"candidate_id": "KC0001", "keep": keep, "severity": "", "review_required": False, "rationale": "why"}], "overall_assessment": "medium_risk", "overall_score": score, "summary": "s"}


def test_review_loops_run_by_contract(spark):
    conflict = {"conflicts": [{"type": "severity_mismatch", "description": "d", "involved_ids": ["R0001"], "resolution": "x"}], "has_material_conflict": True}
    calm = {"conflicts": [], "has_material_conflict": False}
    base = lambda **more: {"clause_risk_review": [clause_risk()], "legal_application_verdict": [verdict()], "final_adjudication": [ruling(60)], "cross_module_arbitration": [calm]} | more
    script = {
        "plain": base(),
        "law": base(legal_application_verdict=[{"verdicts": []}, verdict()]),
        "facts": base(legal_application_verdict=[verdict("insufficient_facts")], final_adjudication=[ruling(50), ruling(55)]),
        "clash": base(cross_module_arbitration=[conflict, calm], final_adjudication=[ruling(40), ruling(70)]),
        "deaf": base(final_adjudication=[None]),
        "mute": {},
        "none": base(clause_risk_review=[{"risks": []}]),
    }
    done, calls = reviewed(spark, script)
    loops = {r["contract_id"]: (r["legal_retries"], r["judge_retries"], r["evidence_rounds"], r["arbitration_rounds"]) for r in done.loops.collect()}
    assert loops == {"plain": (0, 0, 0, 0), "law": (1, 0, 0, 0), "facts": (0, 0, 1, 0), "clash": (0, 0, 0, 1), "deaf": (0, 2, 0, 0), "mute": (0, 0, 0, 0), "none": (0, 0, 0, 0)}
    count = lambda schema: {c: calls[schema].count(c) for c in script}
    assert count("clause_risk_review") == dict.fromkeys(script, 1) | {"facts": 2}
    assert count("final_adjudication") == {"plain": 1, "law": 1, "facts": 2, "clash": 2, "deaf": 2, "mute": 0, "none": 0}
    assert count("cross_module_arbitration") == {"plain": 1, "law": 1, "facts": 1, "clash": 2, "deaf": 1, "mute": 0, "none": 0}
    overall = {r["contract_id"]: (r["overall_assessment"], r["overall_score"]) for r in done.overall.collect()}
    assert overall == {"plain": ("medium_risk", 60), "law": ("medium_risk", 60), "facts": ("medium_risk", 55), "clash": ("medium_risk", 70), "deaf": ("unknown", None), "mute": ("low_risk", 90), "none": ("low_risk", 90)}
    risks = {r["contract_id"]: r for r in done.risks.collect()}
    assert set(risks) == {"plain", "law", "facts", "clash", "deaf"} and risks["law"]["citations"][0]["article_no"] == "第一条"
    assert {c for c, r in risks.items() if r["review_required"]} == {"facts", "deaf"} and risks["deaf"]["confidence"] == 0.5
    assert {r["contract_id"]: r["source"] for r in done.understanding.collect()} == dict.fromkeys(script, "unavailable")
    assert done.conflicts.isEmpty()
    import json

    reports = {r["contract_id"]: json.loads(r["report"]) for r in done.report().collect()}
    assert reports["facts"]["stats"]["loops"]["evidence_rounds"] == 1 and reports["plain"]["stats"]["by_severity"] == {"high": 1} and reports["none"]["stats"]["final_risks"] == 0


def test_understanding_covers_every_clause(spark):
    import json

    tree = spark.createDataFrame([("a", 1, "C0001"), ("a", 2, "C0002"), ("b", 1, "C0001")], "contract_id string, clause_seq int, clause_id string")
    answer = {"contract_type": "租赁", "subject_summary": "s", "payment_summary": "p", "key_obligations": ["o"], "clause_roles": [{"clause_id": "C0002", "role": "付款"}, {"clause_id": "C9", "role": "x"}]}
    rows = {r["contract_id"]: r for r in review.understood(spark.createDataFrame([("a", json.dumps(answer)), ("b", None)], "contract_id string, response string"), tree).collect()}
    assert [tuple(x) for x in rows["a"]["clause_roles"]] == [("C0002", "付款"), ("C0001", "其他")] and rows["a"]["source"] == "llm"
    assert (rows["b"]["source"], rows["b"]["clause_roles"], rows["b"]["contract_type"]) == ("unavailable", [], "") and rows["b"]["unavailable_reason"]


def test_model_findings_and_elements(spark):
    import json

    from clauseflow.operators import checks, elements

    tree = spark.createDataFrame([(c, 1, "C0001", "一", "合同总价100元。", ["B1"]) for c in ("a", "b")], "contract_id string, clause_seq int, clause_id string, label string, text string, block_ids array<string>")
    finding = lambda code, message, ids: {"code": code, "severity": "", "message": message, "evidence": "e", "clause_ids": ids, "confidence": 2}
    good = json.dumps({"findings": [finding("semantic_conflict", "m", ["C0001", "C9"]), finding("other", "m", []), finding("date_conflict", " ", []), finding("semantic_conflict", "m ", [])]})
    said = spark.createDataFrame([("a", 0, good), ("b", 0, good), ("b", 1, None)], "contract_id string, batch int, response string")
    rows = checks.findings(tree, elements.extract(tree), responses=said).collect()
    assert [(r["contract_id"], r["code"], r["severity"], r["clause_ids"], r["confidence"], r["source"]) for r in rows] == [("a", "semantic_conflict", "medium", ["C0001"], 1.0, "m4_llm")]
    more = json.dumps({"amounts": [{"value": "100", "normalized": "100", "role": "r", "clause_id": "C0001", "confidence": 0.99}, {"value": "7元", "normalized": "7", "role": "r", "clause_id": "C9", "confidence": -1}], "parties": [], "dates": [], "subjects": []})
    merged, summary = elements.with_model(tree, spark.createDataFrame([("a", 0, more), ("b", 0, None)], "contract_id string, batch int, response string"))
    assert sorted((r["contract_id"], r["normalized"], r["clause_id"], r["source"], r["confidence"]) for r in merged.collect()) == [("a", "100", "C0001", "llm", 0.99), ("a", "7", None, "llm", 0.0), ("b", "100", "C0001", "rule", 0.82)]
    assert {r["contract_id"]: tuple(r)[1:] for r in summary.collect()} == {"a": (1, 1, 1, 1, 2, 2), "b": (1, 1, 1, 0, 0, 1)}


def test_chat_model_and_embedder():
    import json

    import pytest

    sent = []

    def send(url, payload, headers, timeout):
        sent.append((url, payload, headers))
        if "reasoning_effort" in payload:
            raise transport.ModelError("no such field", 422)
        return {"choices": [{"message": {"content": [{"text": "```json\n{\"x\""}, ": 1}\n```"]}}]}

    model = transport.ChatModel("http://host/v1/", "m", "key", send=send)
    assert json.loads(model("p", "clause_risk_review")) == {"x": 1} and len(sent) == 2
    url, payload, headers = sent[1]
    assert url == "http://host/v1/chat/completions" and headers == {"Authorization": "Bearer key"}
    assert (payload["temperature"], payload["seed"], payload["max_tokens"]) == (0.0, 42, 8_000)
    schema = payload["response_format"]["json_schema"]["schema"]
    item = schema["properties"]["risks"]["items"]
    assert item["properties"]["severity"] == {"type": "string", "enum": ["high", "medium", "low"]} and item["additionalProperties"] is False and schema["required"] == ["risks"]
    assert [transport.chat_url(x) for x in ("http://h", "http://h/v1", " http://h/v1/chat/completions/ ")] == ["http://h/v1/chat/completions"] * 3
    for bad in ({"choices": []}, {"choices": [{"message": {"content": " "}}]}, {"choices": [{"message": {"content": "[1]"}}]}, {"choices": [{"message": {"content": "x"}}]}):
        with pytest.raises(transport.ModelError):
            transport.answer_text(bad)

    def fails(url, payload, headers, timeout):
        raise transport.ModelError("down", 500)

    with pytest.raises(transport.ModelError):
        transport.ChatModel("h", "m", send=fails)("p", "clause_risk_review")
    embedder = transport.HttpEmbedder("http://h/", "m", "k", batch=2, send=lambda url, payload, headers, timeout: {"embeddings": [[1.0]] * len(payload["input"])})
    assert embedder(["a", "b", "c"]) == [[1.0]] * 3
    with pytest.raises(transport.ModelError):
        transport.HttpEmbedder("h", "m", send=lambda *a: {"embeddings": []})(["a"])
