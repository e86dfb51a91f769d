"""Ways that keep large tables off the disk give what the plainer ways give."""

from pyspark.sql import functions as F

from clauseflow.operators import checks, retrieval, structure
from clauseflow.plans import queries, synth

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(str, frame.collect()))


def exchanges(frame):
    return str(frame._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_text_topk_is_sparse_topk(spark):
    texts = ["a b c a", "a b c a", "b", "", None, "款项 c", "a a a z", "z q"] * 40
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = corpus.filter("id % 50 < 9").select(F.col("id").alias("query_id"), "text")
    some = corpus.filter("id % 3 = 0").select("id")
    for repeats in (False, True):
        for among in (None, some):
            want = retrieval.sparse_topk(retrieval.postings(corpus), asked, 7, repeats, among)
            got = retrieval.text_topk(corpus, asked, 7, repeats, among)
            shown = lambda f: rows(f.select("query_id", "id", "rank", F.round("score", 6)))
            assert shown(got) == shown(want)
    names = corpus.select(F.concat(F.lit("d"), F.col("id")).alias("id"), "text")
    assert retrieval.text_topk(names, asked, 7).schema["id"].dataType.simpleString() == "string"
    assert retrieval.text_topk(names, asked.limit(0), 7).count() == 0


def test_trees_need_no_join_and_no_shuffle_of_texts(spark):
    blocks = synth.blocks(spark, SF)
    assert exchanges(blocks) <= 2
    prepared, decided, tree = structure.analyze(blocks)
    assert exchanges(tree) == exchanges(blocks)
    assert rows(tree) == rows(structure.clauses(prepared, decided).select(*tree.columns))
    assert exchanges(checks.check_references(queries._clauses(spark, SF))) == exchanges(blocks)


ODD = {
    "empty": [], "nulls": [None, None], "blank": ["", "第一条 x", None], "heading first": ["第一条 见附件三。", "附件", "附件一"], "no heading": ["见附件3", "甲方：张三", "甲方：李四"],
    "broken": ["前文\n 第二条 总价1,200.00元\n首付款300元；余款800元\r\n附件二 表", "甲方：\n王五五", "第三条 x\n没有标题"], "broken without headings": ["甲方：赵六\n乙方：孙七", "甲方：\n 周八八\x85乙方：吴九九"],
    "blanks": ["  第三条　x", "\u3000１.１ y", "1.1 ", "1.1", "1.1：z", "1.1.1.1.1.1.1 q", "1、3", "1、x", "（十） x", "附录", "附件 二", "见 附件 2、附件二、附件九、附件９、附件0009、附件百", "\u2003", "第五章" + "长" * 178, "第五章" + "长" * 177 + "  "],
    "marks": ["甲方：张\x01三\x02四\x03五", "\x03第一条 总价10元，首付2元，余款3元\x02。", "自2026年3月2日起至2026年3月1日止\x01", "第二条\x02 附件7"],
    "amounts": ["总价款RMB 1,200.00元，定金２００元", "定金200元、余款200元、尾款 1000.01元，金额-5元", "总价款9元"], "few amounts": ["总价款10元；首付款3元", "首付款5元；余款5元"], "even": ["总价10元，首付4元，余款6元，首付4元"],
    "parties": ["出卖人（甲方）：张三公司", "甲方（签章）：张三公司将x 乙方：李四支付", "买受人：李四", "丙方：王五；丙方：王六", "付款方：x1", "甲方：双方", "委托人(供方):孙七七 供方：孙七"],
    "terms": ["自2026年3月2日起至2026年3月1日止，自 2026 年 3月 2日 起 到２０２６年３月１日 止", "第一条 期限为 2026年12月1日—2026年11月30日", "期限自2026年3月2日至2026年3月1日", "自٢٠٢٦年3月2日起至2026年3月1日止", "自2026年03月02日至2026年3月10日止", "期限", "2026年5月2日-2026年5月1日", "自2026年10月9日起至2026年9月30日止，自2026年9月30日起至2026年10月9日止", "自2026年5 月19日至2026年05月9日止，自2026年٧月19日起至2026年٧月18日止", "期限 1月零1日内另计2026年5月4日至2026年5月3日", "期限 1月零一日内另加三四2026年5月6日至2026年5月5日"],
    "crossing": ["期限", "第一条 2026年5月2日-2026年5月1日", "甲方：", "第二条 x", "总价", "第三条 10元，首付3元，余款4元", "附件", "1 x"],
    "summary": ["约定交付 2026年1月1日，起止日期2026年1月2日，交付日期2026年1月2日", "第一条 应于2026年1月1日前，截止日2026年2月1日"], "summary alone": ["约定交付 2026年1月1日"], "far": ["约定交付" + "很" * 30 + "2026年1月1日", "应于2026年1月2日"],
}


def test_counts_of_whole_contracts_are_those_of_findings(spark):
    from clauseflow.operators import elements

    blocks = spark.createDataFrame([(k, i, "paragraph", t) for k, ts in ODD.items() for i, t in enumerate(ts, 1)], "contract_id string, seq int, kind string, text string")
    whole = spark.createDataFrame(list(ODD.items()), "contract_id string, texts array<string>")
    for rows_, held in ((blocks, whole), (synth.blocks(spark, SF), synth.contracts(spark, SF))):
        tree = structure.analyze(rows_)[2].select("contract_id", "clause_seq", "clause_id", "label", "text", "block_ids").localCheckpoint()
        held = held.select("contract_id", structure.paragraph_clauses(F.col("texts")).alias("clauses")).localCheckpoint()
        each = held.select("contract_id", F.posexplode("clauses").alias("i", "c")).select("contract_id", (F.col("i") + 1).alias("clause_seq"), "c.label", "c.text")
        assert rows(each) == rows(tree.select(*each.columns))
        want = checks.findings(tree, elements.extract(tree, ("party", "amount"))).groupBy("contract_id", "code").agg(F.count("*").alias("n"))
        got = checks.counts(held)
        assert rows(got) == rows(want) and got.select("code").distinct().count() == 4


def test_finding_rollup_reads_its_tables_once_and_caches_nothing(spark):
    spark.catalog.clearCache()
    frame = queries.finding_rollup(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Window" not in plan and "Python" not in plan and "InMemoryTableScan" not in plan, plan
    assert exchanges(frame) == 3 and frame.columns == ["code", "n"]


def test_element_signals_read_the_clauses_once(spark):
    from clauseflow.operators import elements, signals

    tree = queries._clauses(spark, SF)
    bad = "第一条 自2026年2月30日起至2026年2月1日止，自2026年3月2日起至2026年3月1日止，租金0元，押金10000000元"
    blocks = spark.createDataFrame([("a", 1, "paragraph", bad), ("a", 2, "paragraph", "第二条 价款"), ("b", 1, "paragraph", ""), ("b", 2, "paragraph", None)], "contract_id string, seq int, kind string, text string")
    for clauses in (tree, structure.analyze(blocks)[2]):
        want = signals.signals(clauses, elements.extract(clauses))
        assert rows(signals.pattern_signals(clauses).select(*want.columns)) == rows(want)
    plan = queries.element_signals(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") + plan.count("Relation") <= 2, plan
    assert exchanges(signals.pattern_signals(tree)) == exchanges(tree)


def test_seeded_corruption_caches_no_lists(spark):
    spark.catalog.clearCache()
    try:
        tree = queries.seeded_corruption(spark, SF)[2]
        cached = str(tree._jdf.queryExecution().withCachedData()).split("InMemoryRelation")
        assert len(cached) == 2 and tree.schema["block_ids"].dataType.simpleString() == "array<string>"
        assert rows(tree.filter("contract_id % 72 not in (0, 8, 9, 16, 18, 24, 27, 32, 36, 40, 45, 48, 54, 56, 63, 64) and contract_id % 11 <> 0").select("contract_id", "clause_id", "block_ids")) == rows(
            queries._clauses(spark, SF).filter("contract_id % 72 not in (0, 8, 9, 16, 18, 24, 27, 32, 36, 40, 45, 48, 54, 56, 63, 64) and contract_id % 11 <> 0").select("contract_id", "clause_id", "block_ids")
        )
        held = tree._jdf.queryExecution().withCachedData().collectLeaves().head().schema()
        assert "array" not in held.simpleString(), held.simpleString()
    finally:
        spark.catalog.clearCache()


def test_merge_is_the_plain_greedy_merge(spark):
    import random

    from clauseflow.operators import elements

    draw = random.Random(7)
    items = [(c, i, f"E{i:04d}", k, draw.choice(["甲", "甲乙", "甲乙丙丁", "乙丙", "丁戊己庚辛", "戊己庚", "x", "1,000"]), "", "", 1, "C0001", [], draw.choice([0.5, 0.7, 0.9]), "rule") for c in range(40) for i, k in enumerate(draw.choices(["party", "date", "amount"], k=14), 1)]
    frame = spark.createDataFrame(items, "contract_id long, seq int, element_id string, kind string, value string, normalized string, role string, clause_seq int, clause_id string, block_ids array<string>, confidence double, source string")
    want = []
    for c in range(40):
        held = []
        for row in (x for x in items if x[0] == c):
            key = row[4].replace(",", "")
            joins = lambda h: h["kind"] == row[3] and row[3] != "amount" and (lambda a, b: len(a) >= 0.5 * len(b) and a in b)(*sorted((h["key"], key), key=len))  # noqa: B023, E731
            target = next((h for h in held if (h["kind"], h["key"]) == (row[3], key)), None) or next((h for h in held if joins(h)), None)
            if target is None:
                held.append({"kind": row[3], "key": key, "value": row[4], "sure": row[10]})
            elif row[10] > target["sure"]:
                target.update(value=row[4], sure=row[10])
        want += [(c, n, h["kind"], h["value"], h["sure"]) for n, h in enumerate(held, 1)]
    merged = elements.merge(frame)
    assert sorted(tuple(r) for r in merged.select("contract_id", "seq", "kind", "value", "confidence").collect()) == want
    assert "Python" not in str(merged._jdf.queryExecution().executedPlan()) and "MapInPandas" not in str(merged._jdf.queryExecution().executedPlan())


def test_plans_of_model_elements_and_outline_issues_stay_small(spark):
    from clauseflow.plans import channel_queries

    for name in ("model_elements", "outline_issues"):
        plan = channel_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 60_000 and plan.count("customer.parquet") <= 3 and plan.count("Window") <= 12, (name, len(plan))
