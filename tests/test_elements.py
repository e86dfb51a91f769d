from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import checks, elements, signals, structure


def analyzed(spark, texts):
    rows = [(k, i, "paragraph", line) for k, t in texts.items() for i, line in enumerate(t.split("\n"), 1)]
    tree = structure.analyze(spark.createDataFrame(rows, "contract_id string, seq int, kind string, text string"))[2]
    return tree, elements.extract(tree)


def test_sale_contract(spark):
    text = "买卖合同\n出卖人（甲方）：张明明；\n买受人（乙方）：李芳芳；\n第一条 房屋坐落于苏州市人民路8号1463室的商品房，建筑面积为141.78平方米。\n第二条 总价款为人民币（小写）1,200,000.00元；首付款人民币（小写）360,000.00元，余款人民币（小写）840,000.00元。\n第三条 签约日期：2026年9月11日。"
    _, found = analyzed(spark, {"s": text})
    got = [(r["kind"], r["normalized"], r["role"]) for r in found.orderBy("seq").collect()]
    assert got == [
        ("party", "张明明", "出卖人（甲方）"), ("party", "李芳芳", "买受人（乙方）"), ("subject", "苏州市人民路8号1463室", "坐落地址"), ("subject", "141.78", "建筑面积"),
        ("amount", "1200000", "合同总价"), ("amount", "360000", "首付款"), ("amount", "840000", "余款"), ("date", "2026-09-11", "签署日"),
    ]


def test_amounts_of_odd_forms(spark):
    _, found = analyzed(spark, {"z": "第三条 租金与押金\n月租金为人民币0元，押金为人民币999999元。违约金-5000元，报酬人民币-12.5元，200000000000000元"})
    assert [(r["value"], r["normalized"], r["role"]) for r in found.orderBy("seq").collect()] == [("0", "0", "租金"), ("999999", "999999", "押金"), ("5000", "5000", "违约金"), ("-12.5", "-12.50", "报酬"), ("0", "0", "金额")]  # 报酬 stands 25 signs before


def test_findings(spark):
    texts = {
        "clean": "第二条 总价款1,200,000.00元；首付款360,000.00元；余款840,000.00元。\n第三条 租赁期限自2026年12月1日起至2027年11月30日止。见附件一。\n附件一 清单",
        "bad": "第二条 总价款1,200,000.00元；首付款360,000.00元；余款860,000.00元。\n第三条 期限 | 2026年12月1日—2026年11月30日，见附件九\n附件一 清单\n甲方（签章）：林云图    乙方（签章）：云图科技公司\n甲方：李磊婷",
        "none": "第一条 见附件三。",
        "dates": "第一条 应于2026年11月28日前交付。\n第二条 约定交付日：2026年12月13日",
    }
    tree, found = analyzed(spark, texts)
    rows = checks.findings(tree, found).orderBy("contract_id", "seq").collect()
    got = {k: [(r["code"], r["severity"], r["confidence"]) for r in rows if r["contract_id"] == k] for k in texts}
    assert got["clean"] == []
    assert got["bad"] == [("amount_conflict", "high", 0.95), ("date_conflict", "medium", 0.9), ("party_conflict", "high", 0.92), ("reference_conflict", "medium", 0.9)]
    assert got["none"] == [("reference_conflict", "low", 0.6)]
    assert got["dates"] == [("date_conflict", "medium", 0.9)]


def test_signals_skip_impossible_dates(spark):
    tree, found = analyzed(spark, {"a": "第一条 自2026年2月30日起至2026年2月1日止，自2026年3月2日起至2026年3月1日止，租金0元，押金10000000元"})
    rows = sorted((r["kind"], r["note"]) for r in signals.signals(tree, found).collect())
    assert [k for k, _ in rows] == ["amount", "amount", "completeness", "completeness", "date"]


def test_merge_equals_plain_python(spark):
    import random

    random.seed(2)
    words = ["甲公司", "甲公司南京分部", "乙厂", "乙", "丙丙丙", "丙丙丙丙丙", "丁（一）", "丁一"]
    rows = [("c", i, "party", random.choice(words), "r", random.choice([0.5, 0.8, 0.9]), f"E{i}") for i in range(60)]
    frame = spark.createDataFrame([(c, i, k, v, v, r, s, e, "rule", 1, "C1", ["B"]) for c, i, k, v, r, s, e in rows], "contract_id string, seq int, kind string, value string, normalized string, role string, confidence double, element_id string, source string, clause_seq int, clause_id string, block_ids array<string>")
    import re

    held, order = {}, []
    for _, _, _, v, _, s, _ in rows:
        key = re.sub(r"[\s,，。；;:：()（）]", "", v).lower()
        match = key if key in held else next((o for o in order if min(len(o), len(key)) >= 0.5 * max(len(o), len(key)) and (o in key or key in o)), None)
        if match is None:
            held[key] = (v, s)
            order.append(key)
        elif s > held[match][1]:
            held[match] = (v, s)
    got = [(r["value"], r["confidence"]) for r in elements.merge(frame).orderBy("seq").collect()]
    assert got == [held[k] for k in order]


def test_matches_give_places(spark):
    import re

    texts = ["", "a1b22c", "１２ 3", "😀7é8", "99"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.matches(F.col("t"), "[0-9]+", 0).alias("m")).collect()
    for r in rows:
        assert [(m["start"], m["stop"], m["g0"]) for m in r["m"]] == [(*m.span(), m.group()) for m in re.finditer("[0-9]+", r["t"])]


def test_numbers_and_dates(spark):
    rows = {"十": 10, "二十三": 23, "九": 9, "二百": None, "12": 12, "": None}
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(k,) for k in rows], "t string").select("t", T.chinese_number(F.col("t")).alias("n")).collect()}
    assert got == rows
    got = spark.range(1).select(T.money_number(F.lit("1,200.00")).alias("a"), T.money_number(F.lit("0.5")).alias("b"), T.money_number(F.lit("x")).alias("c"), T.date_key_of(F.lit("2026 年 1月2日")).alias("d")).first()
    assert tuple(got) == ("1200", "0.50", "x", "2026-01-02")
