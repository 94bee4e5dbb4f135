"""Text predicates and repairs of printed tables, as Column expressions (no Python runs on rows).

Missing text is the empty string; nulls stay null unless a function says otherwise.
Digits and letters are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

_ = F.lit


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def squeeze(text: Column) -> Column:
    """Blank runs become one blank, ends are trimmed."""
    return F.trim(_sub(text, r"(?U)\s+", " "))


def flat(text: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return _sub(F.lower(text), "[^a-z0-9]+")


def token_core(text: Column) -> Column:
    return _sub(squeeze(text), "^[,:;]+|[,:;]+$")


def strip_edges(text: Column) -> Column:
    return _sub(text, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")


def count_value(text: Column) -> Column:
    """One to three digits between other characters, else null."""
    bare = _sub(text, "^[^0-9]+|[^0-9]+$")
    return F.when(bare.rlike("^[0-9]{1,3}$"), bare)


def is_count(text: Column) -> Column:
    return text.rlike(r"^[0-9]{1,3}$")


def is_decimal_tail(text: Column) -> Column:
    return text.rlike(r"^\.[0-9]{2}[A-Za-z]?$")


def is_credit_mark(text: Column) -> Column:
    return text.rlike("^[Cc]$")


def is_totals(text: Column) -> Column:
    return F.lower(F.trim(text)) == "totals"


def looks_like(text: Column, target: str) -> Column:
    """Same length and at most one differing letter, case aside."""
    return (F.length(text) == len(target)) & (F.levenshtein(F.lower(text), _(target.lower())) <= 1)


def is_inked(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9]")


def is_quantity(text: Column) -> Column:
    return text.rlike(r"^(?:-?(?:[0-9]{1,5}|[0-9]{1,3}(?:,[0-9]{3})+)|\([0-9]{1,5}\)|[0-9]{1,5}-)$")


def is_figure(text: Column) -> Column:
    """A quantity or an amount, a leading mark and a trailing one-letter flag aside."""
    figure = lambda b: is_quantity(b) | b.rlike(r"^[(-]?\$?\s?-?[0-9,]*[0-9]\.[0-9]{1,4}\)?-?$")
    bare = F.trim(_sub(_sub(text, r"^[*\s]+"), r"\s+[A-Z*]$"))
    return text.rlike("[0-9]") & F.when(text.rlike(r"^[*\s]|\s[A-Z*]$| $"), figure(bare)).otherwise(figure(text))


def is_code(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9-]{4,24}$") & text.rlike("[0-9]")


def has_money(text: Column) -> Column:
    return text.rlike(r"[0-9]\.[0-9]{2}")


def is_money(text: Column) -> Column:
    return text.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]+\.[0-9]{2})$")


def is_starred(text: Column) -> Column:
    return text.rlike(r"^\*+[^*]+\*+$|^\*+\s")


def is_rule(text: Column) -> Column:
    """Four or more characters of a drawn line."""
    return text.rlike(r"^[-_=.*\s]*$") & _sub(text, r"\s").rlike(r"^[-_=.*]{4,}$")


#: Words by which a document points to another of its pages, letters only.
_POINTS = r"(?:continu(?:e|es|ed|ing)|contd|cont)(?:on|to|from)?(?:the)?(?:next|following|previous|prior|last)?page|(?:on|to|from)(?:the)?(?:next|following|previous|prior)page"


def is_page_continuation(text: Column) -> Column:
    """``continued on next page`` and its kin, however spaced, from the start of a word."""
    marked = F.lower(_sub(text, r"(?<![A-Za-z])(?=[A-Za-z])", "\u0001"))  # word starts stay visible
    letters = _sub(marked, "[^a-z\u0001]")
    spaced = "|".join("\u0001" + part for part in (_spaced(_POINTS),))
    return F.contains(_sub(F.lower(text), "[^a-z]"), _("page")) & letters.rlike(spaced)


def _spaced(pattern: str) -> str:
    """The pattern with an optional word start before each literal letter."""
    out, group = [], False
    for i, c in enumerate(pattern):
        group = c.isalpha() and not (i and pattern[i - 1] == "\\")
        out.append(f"\u0001?{c}" if group else c)
    return "(?:" + "".join(out) + ")"


def is_furniture(text: Column) -> Column:
    """Page numbers, continuation banners and empty lines; text is the line's cells, blank-joined."""
    return let(squeeze(text), _is_furniture)


def _is_furniture(line: Column) -> Column:
    bare = squeeze(_sub(line, "[*=_~]+", " "))
    number = bare.rlike(r"(?i)^(?:page\s*:?\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?|pg\.?\s*:?\s*[0-9]+\s*(?:of|/)\s*[0-9]+|pg\.\s*[0-9]+)$")
    banner = F.lower(_sub(line, "[^A-Za-z]")).isin("continued", "continues", "contd") & line.rlike("[*=-]")
    return (line == "") | number | banner | is_page_continuation(line)


#: Notes that an item is not in stock.
STOCK_NOTE = r"(?i)\bout\s*of\s*stock\b|\bno\s*stock\b"


def stock_notes(text: Column) -> Column:
    return F.regexp_extract_all(text, _(STOCK_NOTE), _(0))


def without_stock_notes(text: Column) -> Column:
    cut = squeeze(_sub(text, STOCK_NOTE, " "))
    return F.when(~text.rlike(STOCK_NOTE), text).when(is_inked(cut), cut).otherwise("")


# Words of a table's totals block.
SUMMARY_WORDS = "sub|sub-?totals?|totals?|tax(?:es|able)?|sales|shipping|ship|freight|handling|discounts?|disc|balance|due|amount|amt|grand|net|payments?|paid|credits?|deposits?|pieces|pcs|cases|items|qty|quantity|units|merchandise|invoice|order|of|and|the"
SUMMARY_KEYS = "sub-?totals?|totals?|tax(?:es)?|balance|freight|shipping|handling|payments?|paid|grand|due"
SUMMARY_TOTALS = "sub-?totals?|totals?|grand|balance|due"
#: What one of these keys or totals stands in, wherever a word ends.
SUMMARY_STEMS = "(?i)(?=[bdfghpst])(?:t(?:otal|ax)|balance|freight|shipping|handling|pa(?:yment|id)|grand|due)"


def is_line_item(cells: Column) -> Column:
    """Quantity with money or code, or money with code, in two filled cells or more; stars that flag
    an item aside, and no money in cells with words."""
    joined = F.array_join(cells, "\x01")
    odd = joined.rlike(r"[*\x00\x02-\x1f\x85\u2028\u2029]") | F.contains(F.array_join(cells, ""), _("\x01"))
    quantity, code, money = (joined.rlike(p) for p in (ONE_QUANTITY, ONE_CODE, ONE_MONEY))
    return F.when(odd, _is_line_item(cells)).otherwise(((quantity & (money | code)) | (money & code)) & joined.rlike(TWO_FILLED))


#: The same of all cells at once, as they stand between marks: a quantity, a code, money without words, two filled cells.
ONE_QUANTITY = r"(?:^|\x01) *(?:-?(?:[0-9]{1,5}|[0-9]{1,3}(?:,[0-9]{3})+)|\([0-9]{1,5}\)|[0-9]{1,5}-) *(?:\x01|$)"
ONE_CODE = r"(?:^|\x01) *(?=[A-Za-z-]*[0-9])[A-Za-z0-9-]{4,24} *(?:\x01|$)"
ONE_MONEY = r"(?:^|\x01)(?![^\x01]*[A-Za-z]{2})[^\x01]*[0-9]\.[0-9]{2}"
TWO_FILLED = r"(?s)[^ \x01].*\x01.*[^ \x01]"


def _is_line_item(cells: Column) -> Column:
    """``is_line_item`` cell by cell, also of cells with stars, line ends or other marks of control."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(_sub(F.trim(c), r"^\*+|\*+$"))), lambda c: c != "")
    money = lambda f: F.exists(f, lambda c: has_money(c) & ~c.rlike("[A-Za-z]{2,}"))
    told = lambda f: F.struct(F.exists(f, is_quantity).alias("quantity"), F.exists(f, is_code).alias("code"), money(f).alias("money"))
    holds = lambda k: (k["quantity"] & (k["money"] | k["code"])) | (k["money"] & k["code"])
    return let(filled, lambda f: (F.size(f) >= 2) & let(told(f), holds))


def is_summary(cells: Column, item: Column) -> Column:
    """A line of the totals block, or a subtotal among the items."""
    lettered = lambda text: F.filter(F.transform(F.split(text, "[^A-Za-z-]+"), lambda w: _sub(w, "^-+|-+$")), lambda w: w.rlike("[A-Za-z]"))
    text = F.array_join(cells, " ")
    return text.rlike(SUMMARY_STEMS) & let(lettered(text), lambda words: _is_summary(cells, words, item))


def _is_summary(cells: Column, words: Column, item: Column) -> Column:
    has = lambda vocabulary: F.exists(words, lambda w: w.rlike(f"(?i)^(?:{vocabulary})$"))
    figured = F.exists(cells, lambda c: F.exists(F.split(squeeze(c), " "), lambda t: (t != "") & is_figure(t)))
    amounts = F.size(F.filter(cells, lambda c: has_money(c) & ~c.rlike("[A-Za-z]{2,}")))
    coded = F.exists(cells, lambda c: is_code(F.trim(c)))
    only = F.forall(words, lambda w: w.rlike(f"(?i)^(?:{SUMMARY_WORDS})$"))
    among = has(SUMMARY_TOTALS) & (only | ((F.size(words) <= 3) & (amounts == 1) & ~coded))
    return (F.size(words) > 0) & F.when(item, among).otherwise(figured & has(SUMMARY_KEYS))


def is_repeated_header(cells: Column, headers: Column) -> Column:
    """Three titles or more, and 60 % of the narrower of both, printed again."""
    want = F.filter(F.transform(headers, flat), lambda x: x != "")
    got = F.filter(F.transform(cells, flat), lambda x: x != "")
    hits = lambda k: F.size(F.filter(k["got"], lambda x: F.array_contains(k["want"], x)))
    again = lambda k: let(hits(k), lambda n: (n >= 3) & (n >= 0.6 * F.least(F.size(k["want"]), F.size(k["got"]))))
    # a cell with a digit is no title without one
    may = (F.regexp_count(F.array_join(cells, "\x01"), _(r"(?:^|\x01)[^0-9\x01]+(?=\x01|$)")) >= 3) | F.array_join(headers, " ").rlike("[0-9]")
    return may & let(F.struct(want.alias("want"), got.alias("got")), again)


def is_lead_in(cells: Column) -> Column:
    """One or two filled cells, all in the first two columns, none a count or beginning with an amount."""
    at = F.filter(F.transform(cells, lambda c, i: F.when(F.trim(c) != "", i)), lambda i: i.isNotNull())
    figures = F.exists(cells, lambda c: F.trim(c).rlike(r"^[0-9]{1,5}$|^\$?[0-9,]+\.[0-9]{2}\b"))
    return F.size(at).between(1, 2) & F.forall(at, lambda i: i < 2) & ~figures


def repair_money_token(token: Column) -> Column:
    """A dollar figure as printed: S for $, O for 0, dots for grouping commas."""
    mangled = token.rlike(r"^S(?:[0-9]{3,}|[0-9]{1,3}[.,][0-9]{3})") & token.rlike(r"^S[0-9Oo.,]+!?$")
    text = F.when(mangled, _sub(token, "^S", r"\$")).otherwise(token)
    bang = F.when(text.endswith("!"), "!").otherwise("")
    inner = _sub(text, r"^\$|!$")
    body = F.translate(inner, "Oo", "00")
    grouped, plain = body.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{3})+$"), body.rlike(r"^[0-9]+(?:\.[0-9]{2})?$")
    fixed = F.concat(_("$"), F.when(grouped, F.translate(body, ".", ",")).otherwise(body), bang)
    return F.when(text.startswith("$") & inner.rlike("^[0-9][0-9Oo.,]*$") & (grouped | plain), fixed).otherwise(token)


def repair_game_name(name: Column) -> Column:
    words = F.transform(F.split(name, " "), repair_money_token)
    priced = F.exists(words, lambda w: w.startswith("$"))
    return F.array_join(F.transform(words, lambda w: F.when(priced & w.rlike("^S[0-9]{1,2}!?$"), _sub(w, "^S", r"\$")).otherwise(w)), " ")


def count_digits(text: Column) -> Column:
    """Digits of a count token with look-alikes put right; empty if digits are under half of it."""
    digits, alnum = F.length(_sub(text, "[^0-9]")), F.length(_sub(text, "[^0-9A-Za-z]"))
    fixed = _sub(F.translate(text, "OoQDIl|", "0000111"), "[^0-9]")
    return F.when((digits == 0) | (digits * 2 < alnum), "").otherwise(fixed)


#: What a text must hold for pack_token to make a pack code of it, and for settled_date to read a date.
PACKED, DATED = "-", "(?:[0-9][^0-9]*){6}"


def pack_token(text: Column) -> Column:
    return let(token_core(text), _pack_token)


def _pack_token(core: Column) -> Column:
    coded = core.rlike("^[0-9SOoBIl]{3}-[0-9SOoBIl]{5,8}$") & (F.length(_sub(core, "[^0-9]")) >= 6)
    return F.when(coded, F.translate(core, "SOoBIl", "500811")).otherwise(core)


def settled_date(text: Column) -> Column:
    """MM/DD/YY from six to eight digits (one or two read from separators), else null."""
    return let(_sub(token_core(text), "[^0-9]"), _settled_date)


def _settled_date(digits: Column) -> Column:
    pick = lambda *cuts: F.concat(*(F.substring(digits, a + 1, b - a) for a, b in cuts))
    n = F.length(digits)
    tries = [F.when(n == 6, digits), F.when(n == 7, pick((0, 2), (3, 7))), F.when(n == 7, pick((0, 4), (5, 7))), F.when(n == 8, pick((0, 2), (3, 5), (6, 8)))]
    sound = F.filter(F.array(*tries), lambda c: c.rlike("^(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"))
    return let(F.try_element_at(sound, _(1)), lambda c: F.when(c.isNotNull(), F.concat_ws("/", F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 2))))


def invoice_amount(text: Column) -> Column:
    """An amount with two decimals and an optional credit mark, from the ways it is misread; else null."""
    token = F.translate(token_core(text), "€", "C")
    token = _sub(token, "[“”\"'‘’`|\\\\™*%\\[\\](){}]+")
    return let(_sub(token, r"^([0-9]+\.[0-9]{2})[0-9]$", "$1"), _invoice_amount)


def _invoice_amount(token: Column) -> Column:
    body, credit = _sub(token, "[¢cC]$"), F.when(token.rlike("[¢cC]$"), "C").otherwise("")
    dotted = F.concat(_sub(body, r"^([0-9])\.([0-9]{3})\.([0-9]{2})$", "$1$2.$3"), credit)
    run = _sub(token, r"\.")
    cents = lambda d: F.concat(F.expr("''"), d.substr(_(1), F.length(d) - 2), _("."), F.right(d, _(2)))
    return (
        F.when(body.rlike(r"^[0-9]\.[0-9]{3}\.[0-9]{2}$"), dotted)
        .when(token.rlike(r"^[0-9]\.[0-9]{4,}$"), cents(run))
        .when(is_money(body), F.concat(body, credit))
        .when(body.rlike("^[0-9]+,[0-9]{2}$"), F.concat(F.translate(body, ",", "."), credit))
        .when(body.rlike("^[0oO]{2,3}$"), F.concat(_("0.00"), credit))
        .when(body.rlike("^[0-9]{4,7}$"), F.concat(cents(body), credit))
    )


def cents(text: Column) -> Column:
    """Money text as whole cents, negative with a trailing credit mark; null if it is none."""
    credit = F.trim(text).rlike("[Cc]$")
    bare = _sub(_sub(F.trim(text), "[Cc]$"), r"[$,\s]")
    value = F.floor(bare.try_cast("double") * 100 + 0.5).cast("long")
    return F.when(bare.rlike(r"^[0-9]+(?:\.[0-9]{1,2})?$"), F.when(credit, -value).otherwise(value))


def money(cents_: Column) -> Column:
    whole = F.abs(cents_)
    return F.concat(F.when(cents_ < 0, "-").otherwise(""), F.floor(whole / 100).cast("string"), _("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def count_number(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[0-9]{1,3}$"), F.trim(text).try_cast("int"))


def slugify(text: Column) -> Column:
    slug = F.substring(_sub(_sub(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$"), 1, 48)
    return F.when(slug == "", "table").otherwise(slug)


# A key with its figure, and what a key to marks looks like: definitions, words that explain, marks.
# A key begins at its last letter: as many matches as from its first, without a scan of the line from each of its letters.
KEYED_FIGURE = r"[A-Za-z][.\s]*+:\s*\$?-?[0-9,]+(?:\.[0-9]+)?"
DEFINES, EXPLAINS, MARKS = r"[A-Za-z0-9]\s*=\s*[A-Za-z0-9]", r"(?i)\b(?:denotes?|means?|indicates?|abbreviat\w*|legend|key)\b", r"[*+#†‡]|\b[A-Z]\b"


def is_document_total(text: Column) -> Column:
    """Two keyed figures or more on one line."""
    return F.regexp_count(text, _(KEYED_FIGURE)) >= 2


def is_legend(text: Column) -> Column:
    """A key to the document's marks; text is upper case."""
    return text.rlike(DEFINES) | (text.rlike(EXPLAINS) & text.rlike(MARKS))


def page_range(pages: Column) -> Column:
    """Sorted distinct page numbers as ``1-3, 5``."""
    opened = F.aggregate(
        pages,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, _(-1))["b"] == p - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, _(0))), F.array(F.struct(F.try_element_at(acc, _(-1))["a"].alias("a"), p.cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("a"), p.cast("int").alias("b"))))),
    )
    return F.array_join(F.transform(opened, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))), ", ")


def csv_field(text: Column) -> Column:
    """Quoted only where it must be."""
    return F.when(text.rlike('[",\\r\\n]'), F.concat(_('"'), F.replace(text, _('"'), _('""')), _('"'))).otherwise(text)
