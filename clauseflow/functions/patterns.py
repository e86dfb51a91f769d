"""Values that results depend on: patterns, word lists and thresholds of contract review.

Fixed values, as plain text in their order of precedence. Patterns are for Java with (?U), so that \\s and \\d are Unicode's.
"""

#: Signs that set clauses and matches apart in texts joined for one search; what has them already is searched by parts.
MARKS = "\x01\x02\x03"

CHINESE_NUMBER = "零〇一二三四五六七八九十百千万两"
SENTENCE_ENDINGS = "。；！？!?"
BODY_CUES = "应当|应于|应在|不得|有权|负责|必须|须在|可以|同意|保证|承诺|支付|交付|承担"

#: (pattern of the label, of what follows it, kind, level; level 0 is counted from a decimal label).
_NUMBERED = (
    (rf"第[{CHINESE_NUMBER}0-9]+章", r"(?:[\s：:、.-]*)(.*)$", "chapter", 1),
    (rf"第[{CHINESE_NUMBER}0-9]+节", r"(?:[\s：:、.-]*)(.*)$", "section", 2),
    (rf"第[{CHINESE_NUMBER}0-9]+条(?:之[{CHINESE_NUMBER}0-9]+)?", r"(?:[\s：:、.-]*)(.*)$", "article", 2),
    (rf"第[{CHINESE_NUMBER}0-9]+款", r"(?:[\s：:、.-]*)(.*)$", "paragraph", 3),
    (r"\d+(?:\.\d+){1,5}", r"(?:[\s：:、.-]+)(.*)$", "decimal", 0),
    (r"\d{1,3}[.、]", r"(?!\d)(?:\s*)(.*)$", "arabic_list", 2),
    (rf"[{CHINESE_NUMBER}]+、", r"(?:\s*)(.*)$", "chinese_list", 2),
    (rf"[（(][{CHINESE_NUMBER}]+[）)]", r"(?:\s*)(.*)$", "chinese_item", 3),
    (r"[（(]\d{1,3}[）)]", r"(?:\s*)(.*)$", "arabic_item", 4),
    (r"(?:附件|附录)\s*[一二三四五六七八九十0-9]*", r"[：:\s、.-]*(.*)$", "appendix", 1),
)

#: (pattern of label and remainder, kind, level), the first that matches wins.
HEADINGS = tuple((rf"(?U)^({label}){rest}", kind, level) for label, rest, kind, level in _NUMBERED)

#: Group 1 is the label of the first of these that matches.
HEADING_LABEL = "(?U)^(" + "|".join(f"{label}(?={rest})" for label, rest, _, _ in _NUMBERED) + ")"

#: What a line must begin with to match any of these.
HEADING_BEGINS = rf"(?U)^[第\d{CHINESE_NUMBER}（(附]"

_BLANK = r"[\s&&[^\n]]"
#: The same for lines after a line feed each, of a text without other breaks: groups are the blanks before a label, the label.
#: What follows a label must fit for two kinds only; the line without the blanks at its ends has at most 180 signs.
_AFTER = {"decimal": rf"(?=[\s：:、.-])(?!{_BLANK}*(?:\n|\z))", "arabic_list": r"(?!\d)"}
HEADING_LINE = rf"(?U)\n({_BLANK}*)(?={HEADING_BEGINS[5:]})(?=.{{1,180}}{_BLANK}*(?:\n|\z))(" + "|".join(label.replace(r"\s", _BLANK) + _AFTER.get(kind, "") for label, _, kind, _ in _NUMBERED) + ")"

PARTY_ROLES = "出卖人|买受人|甲方|乙方|丙方|丁方|委托方|受托方|寄存人|保管人|出租人|承租人|中介人|委托人|数据提供方|数据接收方|供方|需方"
#: Groups: role, role in brackets, role alone, name.
_ROLE_BEGINS = f"(?=[{''.join(sorted({role[0] for role in PARTY_ROLES.split('|')}))}])"
PARTY = rf"(?U){_ROLE_BEGINS}(?:({PARTY_ROLES})[（(]([^）)]{{1,12}})[）)]|({PARTY_ROLES}))[：:]\s*((?:(?!{_ROLE_BEGINS}(?:{PARTY_ROLES})[（(])[^\s；;，,。\n（(]){{2,30}})"
#: The same, but no match reaches past the last mark.
PARTY_APART = PARTY.replace("[^）)]", f"[^）){MARKS[2]}]").replace(r"[^\s；;", rf"[^{MARKS[2]}\s；;")
#: Groups: prefix, value.
MONEY = r"(?U)(?=[人R¥￥（(小\s0-9-])(人民币|RMB|¥|￥|-)?\s*(?:[（(]?\s*小写\s*[）)]?)?\s*(-?(?:0(?:\.\d{1,2})?|[1-9]\d{0,2}(?:,\d{3})+(?:\.\d{1,2})?|[1-9]\d{0,10}(?:\.\d{1,2})?))\s*元"
DATE = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
ADDRESS = r"(?U)坐落于\s*([^\n，。；]{4,60}?)\s*(?:的(?:商品房|房屋|房产)|；|。|，|$)"
AREA = r"(?U)建筑面积(?:为)?\s*([\d.]+)\s*平方米"
_DAY = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
TERM_RANGE = rf"(?U)自\s*({_DAY})\s*起?\s*[至到]\s*({_DAY})\s*止"
TERM_SPAN = rf"(?U)期限[^\n]{{0,12}}({_DAY})\s*[—\-~～至到]\s*({_DAY})"
#: The same terms, their groups the numbers of both days, and what every match holds; none reaches past the last mark.
_NUMBERS = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
TERM_NUMBERS = tuple((pattern.replace(f"({_DAY})", _NUMBERS), pattern.replace(f"({_DAY})", _NUMBERS).replace(r"[^\n]", rf"[^\n{MARKS[2]}]"), needs) for pattern, needs in ((TERM_RANGE, "止"), (TERM_SPAN, "期限")))
ATTACHMENT = r"(?U)附件\s*([零一二三四五六七八九十百]+|\d+)"

#: (keyword, role), earlier entries win ties.
MONEY_ROLES = (
    ("总价款", "合同总价"), ("总价", "合同总价"), ("合计", "合同总价"), ("首付", "首付款"), ("定金", "定金"), ("预付款", "预付款"),
    ("余款", "余款"), ("尾款", "余款"), ("保证金", "保证金"), ("违约金", "违约金"), ("租金", "租金"), ("押金", "押金"),
    ("报酬", "报酬"), ("保管费", "服务费"), ("服务费", "服务费"), ("单价", "单价"),
)
DATE_ROLES = (
    ("签约日期", "签署日"), ("签订", "签署日"), ("签署", "签署日"), ("交付", "交付日"), ("登记", "登记日"), ("生效", "生效日"),
    ("届满", "到期日"), ("止", "到期日"),
)
PARTY_CUTS = (
    "甲方", "乙方", "丙方", "丁方", "出卖人", "买受人", "委托人", "受托人", "寄存人", "保管人", "出租人", "承租人", "中介人", "供方", "需方",
    "签章", "盖章", "签字", "签约", "签订", "签署", "通讯地址", "户籍", "联系电话", "委托", "办理",
    "将", "应当", "应", "须", "负责", "同意", "承诺",
)
PARTY_VERBS = ("保管", "支付", "提供", "交付", "委托", "办理", "收取")
PARTY_BLOCKED = ("双方", "各方", "一方", "对方", "甲方", "乙方", "丙方")
PARTY_SIDES = {
    "甲方": "甲方", "出卖人": "甲方", "出租人": "甲方", "委托人": "甲方", "寄存人": "甲方", "需方": "甲方", "数据接收方": "甲方", "付款方": "甲方",
    "乙方": "乙方", "买受人": "乙方", "承租人": "乙方", "受托人": "乙方", "保管人": "乙方", "供方": "乙方", "中介人": "乙方", "数据提供方": "乙方",
    "丙方": "丙方", "丁方": "丁方",
}
PARTY_PRIMARY = tuple(r for r in PARTY_SIDES if r != "付款方")
CHINESE_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

SUMMARY_DATE_CUES = ("约定交付", "交付日期", "起止日期")
CLAUSE_DATE_CUES = ("应于", "应当于", "期限", "交付日", "截止日")
NO_LABEL = ("", "前言", "标题", "未编号")
EXTREME_AMOUNT = 10_000_000
MISSING_NOTES = {"party": "未提取到当事人信息", "amount": "未提取到任何金额", "date": "未提取到任何日期", "subject": "未提取到标的描述"}
RISK_LABELS = {
    "term_over_20y": "租赁期限超过二十年", "zero_rent": "租金为零", "negative_fee": "费用为负数", "deposit_over_20pct": "定金超过主合同标的额百分之二十",
    "extreme_rent": "租金金额极端异常", "unlimited_authority": "授予无限授权", "unilateral_entry": "单方随意进入/处置", "unverified_property": "标的无权属证明",
    "no_report": "受托人无报告义务", "unfair_term": "权利义务显失公平", "missing_element": "缺少必要条款要素", "illegal_clause": "涉嫌违反强制性规定",
    "ambiguous_wording": "条款表述含歧义", "semantic_conflict": "跨条款语义矛盾", "amount_conflict": "金额一致性问题", "date_conflict": "日期一致性问题",
    "party_conflict": "主体一致性问题", "reference_conflict": "引用完整性问题",
}
ASSESSMENTS = {
    "legal_risk": "法律风险", "commercial_unreasonable": "商业不合理", "rights_imbalance": "权利义务失衡", "performance_risk": "履约风险",
    "insufficient_facts": "事实不足", "need_more_material": "需要补充材料", "no_substantive_risk": "未发现实质风险",
}
#: Codes that an element signal on the same clause confirms.
CONFIRMED_CODES = ("zero_rent", "negative_fee", "extreme_rent", "deposit_over_20pct", "date_conflict", "date_reversed", "term_over_20y", "missing_element", "invalid_date_range")
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
