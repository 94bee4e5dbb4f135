import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as T

CASES = [
    (T.token_core, " ,Total:; ", "Total"), (T.strip_edges, "--ab-c..", "ab-c"), (T.count_value, "(12)", "12"), (T.count_value, "1234", None),
    (T.is_quantity, "1,234", True), (T.is_quantity, "123456", False), (T.is_quantity, "(12)", True), (T.is_quantity, "12-", True),
    (T.is_figure, "* 12.50", True), (T.is_figure, "12.50 T", True), (T.is_figure, "abc", False), (T.is_money, "1,234.00", True), (T.is_money, "12.5", False),
    (T.is_rule, "- - - -", True), (T.is_rule, "---", False), (T.is_starred, "***NOTE***", True), (T.is_starred, "* note", True), (T.is_starred, "a*", False),
    (T.is_page_continuation, "Continued on next page", True), (T.is_page_continuation, "CONT'D ON NEXT PAGE", True), (T.is_page_continuation, "c o n t i n u e d page", True),
    (T.is_page_continuation, "discontinued page", False), (T.is_page_continuation, "from the previous page", True), (T.is_page_continuation, "homepage", False),
    (T.is_furniture, "Page 1 of 2", True), (T.is_furniture, "== Page: 3 ==", True), (T.is_furniture, "", True), (T.is_furniture, "*** CONTINUED ***", True), (T.is_furniture, "CONTINUED", False), (T.is_furniture, "Page of x", False),
    (T.without_stock_notes, "MINT OUT OF STOCK", "MINT"), (T.without_stock_notes, "no stock", ""), (T.without_stock_notes, "a  b", "a  b"),
    (T.repair_money_token, "S1,000", "$1,000"), (T.repair_money_token, "$5O.OOO!", "$50,000!"), (T.repair_money_token, "S50", "S50"), (T.repair_money_token, "$1.5", "$1.5"), (T.repair_money_token, "SUN", "SUN"),
    (T.repair_game_name, "$100 S50 FUN", "$100 $50 FUN"), (T.repair_game_name, "S50 FUN", "S50 FUN"),
    (T.count_digits, "O12", "012"), (T.count_digits, "abc1", ""), (T.count_digits, "l2|", "121"),
    (T.pack_token, "S23-0O45678:", "523-0045678"), (T.pack_token, "SOS-BOOBOO", "SOS-BOOBOO"),
    (T.settled_date, "01/12/26", "01/12/26"), (T.settled_date, "01712/26", "01/12/26"), (T.settled_date, "01/11/2026", "01/12/26"), (T.settled_date, "02/28/2026", None), (T.settled_date, "13/01/26", None),
    (T.invoice_amount, "1.234.56C", "1234.56C"), (T.invoice_amount, "1.2345", "123.45"), (T.invoice_amount, "12,34", "12.34"), (T.invoice_amount, "OOO", "0.00"), (T.invoice_amount, "12345", "123.45"),
    (T.invoice_amount, "“12.345", "12.34"), (T.invoice_amount, "1,234.56€", "1,234.56C"), (T.invoice_amount, "abc", None), (T.invoice_amount, "123", None),
    (T.cents, "$1,234.5", 123450), (T.cents, "12.34C", -1234), (T.cents, "x", None), (T.money, -1205, "-12.05"), (T.slugify, "Previous Balances!", "previous-balances"), (T.slugify, "--", "table"),
    (T.is_document_total, "TOTAL: 12.00 TAX: $1.10", True), (T.is_document_total, "TOTAL: 12.00", False), (T.is_legend, "* DENOTES A CHANGE", True), (T.is_legend, "T = TAXED", True), (T.is_legend, "PLAIN LINE", False),
    (T.page_range, [1, 2, 3, 5], "1-3, 5"), (T.page_range, [], ""), (T.page_range, [4], "4"), (T.csv_field, 'x"y', '"x""y"'), (T.csv_field, "plain", "plain"),
    (T.is_lead_in, ["AB", "CD", ""], True), (T.is_lead_in, ["AB", "", "x"], False), (T.is_lead_in, ["12", ""], False),
    (T.is_line_item, ["*10234", "WIDGET", "5.00"], True), (T.is_line_item, ["*2", "WIDGET", "5.00"], True), (T.is_line_item, ["2", "SUB TOTAL 12.00"], False),
    (T.is_line_item, ["2", "LEAF BAG", "17.35"], True), (T.is_line_item, ["", "LEAF BAG", ""], False), (T.is_totals, " Totals ", True),
]


@pytest.fixture(scope="module")
def answers(spark):
    one = spark.range(1)
    return one.select(*(f(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<string>" if x and isinstance(x[0], str) else "array<int>")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES))).first()


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{f.__name__}-{x}" for f, x, _ in CASES])
def test_case(answers, i):
    assert answers[i] == CASES[i][2]


@pytest.mark.parametrize(("cells", "item", "want"), [(["SUB TOTAL", "12.00"], False, True), (["TOTAL BAG", "1", "12.00"], True, True), (["LEAF", "2", "3.00"], True, False), (["", "note"], False, False)])
def test_summary(spark, cells, item, want):
    assert spark.range(1).select(T.is_summary(F.array(*map(F.lit, cells)), F.lit(item)).alias("x")).first().x is want
