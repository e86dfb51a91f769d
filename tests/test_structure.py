from clauseflow.operators import elements, structure, validate

TEXTS = {
    "tree": ["第一章 总则", "第一条 合同目的", "双方约定如下。", "（一）服务范围", "提供技术服务。"],
    "inline": ["第一条 甲方应当在十日内支付全部款项。"],
    "decimals": ["1. 项目", "1.1 服务", "1.1.1 服务范围"],
    "lines": ["第一条 标题\n正文内容\n第二条 标题二"],
    "plain": ["合同名称", "第一条 服务内容", "乙方提供服务。", "第二条 合同价款", "价款为100元。"],
    "figure": ["141.78平方米", "1.1服务", ""],
}


def blocks(spark, texts=TEXTS):
    rows = [(k, i, "paragraph", t) for k, ts in texts.items() for i, t in enumerate(ts, 1)]
    return spark.createDataFrame(rows, "contract_id string, seq int, kind string, text string")


def test_clause_tree(spark):
    _, decided, tree = structure.analyze(blocks(spark))
    got = {}
    for r in tree.orderBy("contract_id", "clause_seq").collect():
        got.setdefault(r["contract_id"], []).append((r["label"], r["title"], r["level"], r["body"], r["parent_id"]))
    assert got["tree"] == [("第一章", "总则", 1, "", None), ("第一条", "合同目的", 2, "双方约定如下。", "C0001"), ("（一）", "服务范围", 3, "提供技术服务。", "C0002")]
    assert got["inline"] == [("第一条", "", 2, "甲方应当在十日内支付全部款项。", None)]
    assert [x[2] for x in got["decimals"]] == [2, 3, 4]
    assert [x[:2] for x in got["lines"]] == [("第一条", "标题"), ("第二条", "标题二")]
    assert [x[0] for x in got["plain"]] == ["前言", "第一条", "第二条"]
    assert [x[2] for x in got["figure"]] == [0]
    relations = [(r["relation"], r["confidence"]) for r in decided.filter("contract_id = 'lines'").orderBy("seq").collect()]
    assert relations == [("CONTINUATION", 0.9), ("NEW_CLAUSE", 0.98)]
    assert {r["confidence"] for r in decided.filter("contract_id = 'figure'").collect()} == {0.42}


def test_parents_equal_a_stack(spark):
    import random

    random.seed(1)
    levels = {str(c): [random.randint(0, 5) for _ in range(30)] for c in range(10)}
    rows = [(c, i, level) for c, ls in levels.items() for i, level in enumerate(ls, 1)]
    got = {(r["contract_id"], r["clause_seq"]): r["parent_seq"] for r in structure.with_parents(spark.createDataFrame(rows, "contract_id string, clause_seq int, level int")).collect()}
    for c, ls in levels.items():
        stack = []
        for i, level in enumerate(ls, 1):
            while stack and stack[-1][0] >= level:
                stack.pop()
            assert got[c, i] == (stack[-1][1] if stack and level else None)
            if level:
                stack.append((level, i))


def test_model_opened_clauses_go_deeper(spark):
    prepared = structure.with_headings(structure.prepare_blocks(blocks(spark, {"a": ["第一条 题目", "x", "y", "z", "w"]})))
    decided = structure.boundaries(prepared)
    from pyspark.sql import functions as F

    decided = decided.withColumn("relation", F.when(F.col("seq").isin(2, 3), "NEW_SUBCLAUSE").when(F.col("seq") == 5, "NEW_CLAUSE").otherwise(F.col("relation")))
    tree = structure.clauses(prepared, decided).orderBy("clause_seq").collect()
    assert [(r["label"], r["level"]) for r in tree] == [("第一条", 2), ("未编号", 3), ("未编号", 4), ("未编号", 2)]


def test_issues_of_broken_trees(spark):
    b = spark.createDataFrame([("a", 1, "B1"), ("a", 2, "B2"), ("a", 3, "B2")], "contract_id string, seq int, block_id string")
    rows = [("a", 1, "C1", "第一条", 2, None, ["B1", "BX"]), ("a", 2, "C2", "第一条", 2, "C1", ["B1"]), ("a", 3, "C3", "2.1", 3, "C9", []), ("a", 4, "C4", "3.1", 3, None, [])]
    t = spark.createDataFrame(rows, "contract_id string, clause_seq int, clause_id string, label string, level int, parent_id string, block_ids array<string>")
    d = spark.createDataFrame([("a", 2, "B1", "B9", 0.5)], "contract_id string, seq int, left_id string, right_id string, confidence double")
    codes = sorted(r["code"] for r in validate.issues(b, t, d).collect())
    assert codes == sorted(["duplicate_block_id", "orphan_block_reference", "uncovered_block", "duplicated_block", "boundary_mismatch", "missing_parent", "parent_level_invalid", "duplicate_label", "decimal_parent_missing", "low_confidence_boundary"])


def test_empty_tables(spark):
    prepared, decided, tree = structure.analyze(blocks(spark).limit(0))
    assert tree.isEmpty() and validate.issues(prepared, tree, decided).isEmpty() and elements.extract(tree).isEmpty()
