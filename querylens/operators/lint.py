"""Lint rules as predicates over the words of statement shapes.

Most rules look at one word and what the table says about its place: they are evaluated together in one
pass, as one array of findings for each word. Rules about a whole select, query or statement are the same
pass over a word that stands for it, with window sums over its words. All of this happens once for each
distinct shape; findings are joined back to the statements of that shape, which give them their places.
Only then come the rules that need other rows' facts: columns against the catalog of their own document,
joined by document and name, and against an outer catalog, joined by name.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.plans.dialects import dialect_caps
from querylens.plans.rules import rules_table, selected
from querylens.sources.work import stored

from .catalog import inline_columns
from .masks import LONGEST, distinct_masks, masked, unmasked
from .tokens import KEYWORDS, MARK, shape_id, shapes, statements, word_table

COMPARISONS = ("=", "<>", "!=", "<", "<=", ">", ">=")
#: Types in floating point, and what names of amounts hold.
FLOATS = ("FLOAT", "REAL", "DOUBLE", "FLOAT4", "FLOAT8", "FLOAT32", "FLOAT64")
MONEY = "price|amount|total|balance|cost|fee"
CATALOG_RULES = ("QL0400", "QL0505", "QL0900")
#: A mask has at most four digits for each run, and no more runs than characters.
LONGEST_MASK = 4 * LONGEST
#: Words of shapes in one task of their windows, about: over all their sorts these were measured to take 1,350 MB.
TASK_WORDS = 50_000


def _b(i: int) -> Column:
    return F.get("before", F.lit(i - 1))


def _a(i: int) -> Column:
    return F.get("after", F.lit(i - 1))


def _isin(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _eq(c: Column, value: str) -> Column:
    return F.coalesce(c == value, F.lit(False))


def _name(up: Column) -> Column:
    """Whether a word is a column's name: quoted, dotted, or one that isn't a keyword."""
    return F.coalesce(F.regexp_like(up, F.lit(r"\A[A-Z_@`\"\[\x{80}-\x{10FFFF}]")) & ~up.isin(*KEYWORDS) & (up != "["), F.lit(False))


def _number(up: Column) -> Column:
    return F.coalesce(F.regexp_like(up, F.lit(r"\A\.?[0-9]")), F.lit(False))


def name_parts(word: Column) -> Column:
    """The parts of a dotted name, without quotes, in lower case."""
    parts = F.regexp_extract_all(word, F.lit(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+'), F.lit(0))
    return F.transform(parts, lambda x: F.lower(F.regexp_replace(x, r"\A[\"`\[]|[\"`\]]\z", "")))


def last_part(word: Column) -> Column:
    parts = name_parts(word)
    return F.get(parts, F.size(parts) - 1)


def _with_sums(t: DataFrame) -> DataFrame:
    """Counts over the select, query, clause and statement that a word stands in."""
    word, up, own = F.col("kind") == "word", F.col("up"), F.col("own")
    n = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    query = Window.partitionBy("sid", "q_depth", "q_block")
    select = Window.partitionBy("sid", "q_depth", "q_block", "select_no")
    join = Window.partitionBy("sid", "q_depth", "q_block", "select_no", "join_no")
    clause = Window.partitionBy("sid", "depth", "block", "q_block", "clause_no")
    statement = Window.partitionBy("sid")
    so_far = lambda w: w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("or_no", n(word & (up == "OR")).over(so_far(clause)))
    between = F.exists(F.slice("before", 1, 5), lambda x: x == "BETWEEN")
    plain_and = word & (up == "AND") & ~between
    part = Window.partitionBy("sid", "depth", "block", "q_block", "clause_no", "or_no")
    comma, is_from = up == ",", own & (F.col("clause") == "FROM")
    return t.withColumns({
        "n_from": n(comma & is_from).over(select) + 1, "n_joins": n(word & (up == "JOIN") & is_from).over(select),
        "n_cross": n(word & (up == "JOIN") & is_from & _eq(_b(1), "CROSS")).over(select), "n_where": n(word & own & (up == "WHERE")).over(select),
        "n_having": n(word & own & (up == "HAVING")).over(select), "n_group": n(word & own & (up == "GROUP")).over(select),
        "n_items": n(comma & own & (F.col("clause") == "SELECT")).over(select) + 1, "n_selects": n(word & own & (up == "SELECT")).over(query),
        "n_order": n(word & own & (up == "ORDER") & _eq(_a(1), "BY")).over(query), "n_limit": n(word & own & up.isin("LIMIT", "OFFSET")).over(query),
        "limit_no": n(word & own & up.isin("LIMIT", "OFFSET")).over(so_far(query)), "has_on": n(word & own & up.isin("ON", "USING")).over(join),
        "n_and": n(plain_and).over(part), "n_and_first": n(plain_and & (F.col("or_no") == 0)).over(clause),
        "s_where": n(word & (up == "WHERE") & (F.col("depth") == 0)).over(statement),
        "s_into": F.min(F.when(word & (up == "INTO"), F.col("pos"))).over(statement), "s_from": F.min(F.when(word & (up == "FROM"), F.col("pos"))).over(statement),
        "s_select": F.min(F.when(word & up.isin("SELECT", "WITH"), F.col("pos"))).over(statement), "s_table": F.min(F.when(word & (up == "TABLE"), F.col("pos") + F.when(_eq(_a(1), "IF"), 4).otherwise(1))).over(statement),
        "where_at": F.max(F.when(word & own & (up == "WHERE"), F.struct("pos", *(_a(i).alias(f"a{i}") for i in range(1, 7))))).over(select),
    })


def _statement_at() -> Column:
    """The word that a whole statement's finding points at: a query's first word, the table that is written, the table that is created."""
    first = F.col("first")
    return (
        F.when(first == "(", F.col("s_select")).when(first.isin("SELECT", "WITH", "VALUES", "TABLE"), 0)
        .when(first.isin("INSERT", "REPLACE"), F.coalesce(F.col("s_into") + 1, F.lit(1))).when(first == "UPDATE", F.when(F.col("second").isin("LOW_PRIORITY", "IGNORE", "ONLY"), 2).otherwise(1))
        .when(first == "DELETE", F.col("s_from") + 1).when(first == "CREATE", F.col("s_table"))
    )


def _rules(src: Column, dst: Column) -> dict[str, tuple[Column, Column]]:
    """Each rule's condition on a word, and the word that its finding points at; null for the statement's first line."""
    up, kind, clause, own, pos = F.col("up"), F.col("kind"), F.col("clause"), F.col("own"), F.col("pos")
    word, raw, first = kind == "word", F.col("is_raw"), F.col("first")
    q_opener, outer = F.col("q_opener"), F.col("outer")
    whole, here, operand = _statement_at(), pos, F.col("operand")
    mysql = src.isin("mysql", "mariadb")
    in_query = F.col("n_selects") > 0
    is_select = word & own & (up == "SELECT")
    nested = F.coalesce(F.col("q_depth"), F.lit(0)) > 0
    head = nested & (pos == q_opener["pos"] + 1)  # a subquery's first word
    lacks = lambda c: dst.isNotNull() & ~F.coalesce(F.col(f"to_{c}"), F.lit(True))
    returning = word & (up == "RETURNING") & (F.col("depth") == 0)
    duplicate = word & (up == "DUPLICATE") & _eq(_b(1), "ON") & _eq(_a(1), "KEY") & (first == "INSERT")
    conflict = word & (up == "CONFLICT") & _eq(_b(1), "ON") & (first == "INSERT")
    is_join = word & own & (up == "JOIN") & _eq(clause, "FROM")
    natural = _eq(_b(1), "NATURAL") | _eq(_b(2), "NATURAL") | _eq(_b(3), "NATURAL")
    # An identifier within an expression: not a table's, an alias's or a function's name, nor what is assigned to.
    assigned = _isin(clause, "SET", "UPDATE") & own & _isin(_b(1), "SET", ",", "UPDATE") & _eq(_a(1), "=")
    after_operand = F.coalesce(F.regexp_like(_b(1), F.lit(r"\A(?:[A-Z0-9_@`\"'\[\x{80}-\x{10FFFF}].*|\))\z")), F.lit(False)) & ~_isin(_b(1), *KEYWORDS)
    listed = _eq(clause, "INTO") | (_eq(clause, "FROM") & ~F.col("in_on"))
    expression = _isin(clause, "SELECT", "WHERE", "GROUP", "HAVING", "ORDER", "FROM", "SET", "UPDATE", "VALUES", "RETURNING") & ~listed & ~assigned & ~_isin(_b(1), "AS", "INTO", "UPDATE") & ~after_operand & ~_eq(_a(1), "(") & ~(_eq(clause, "UPDATE") & (first == "UPDATE"))
    quoted_by = lambda mark: F.exists(F.regexp_extract_all("tok", F.lit(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+'), F.lit(0)), lambda x: x.startswith(mark))
    # ON TRUE, ON n = n, in up to three grouping parentheses.
    stops = lambda c: c.isNull() | _isin(c, "WHERE", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "OFFSET", "FETCH", "WINDOW", ")", ",")
    taut = F.lit(False)
    for k in range(4):
        opened, at = F.lit(True), k + 1
        for i in range(1, k + 1):
            opened &= _eq(_a(i), "(")
        for ends_at, body in ((at + 1, _eq(_a(at), "TRUE")), (at + 3, _number(_a(at)) & _eq(_a(at + 1), "=") & F.coalesce(_a(at) == _a(at + 2), F.lit(False)))):
            closed = F.lit(True)
            for i in range(k):
                closed &= _eq(_a(ends_at + i), ")")
            taut |= opened & body & closed & (stops(_a(ends_at + k)) if ends_at + k <= 9 else F.lit(True))
    compared = up.isin(*COMPARISONS) & (kind == "sign")
    assignment = own & _isin(clause, "SET", "UPDATE") & _isin(_b(2), "SET", ",", "UPDATE")
    ends_operand = lambda c: c.isNull() | _isin(c, "AND", "OR", ")", ",", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "RETURNING", "THEN", "ELSE", "END", "WHEN", "OFFSET", "FETCH", "WINDOW", "FOR")
    after, before = F.col("call_after"), F.col("call_before")
    call_right = _eq(_a(2), "(") & F.coalesce(after["call"] & after["bare"] & ends_operand(after["closer"]), F.lit(False))
    call_left = F.coalesce(before["closes"] & before["call"] & before["bare"] & (before["pos"] - 1 == operand), F.lit(False))
    single_left = operand == pos - 1  # the whole left side is one word
    count = word & (up == "COUNT") & _eq(_a(1), "(")
    counts_column = count & ((_name(_a(2)) & _eq(_a(3), ")")) | (_eq(_a(2), "DISTINCT") & _name(_a(3)) & _eq(_a(4), ")")))
    # a = x OR b = y: on each side one comparison with a column on one of its sides.
    left, right_end = F.col("last"), F.col("next")
    side = lambda x, op, y: F.when(op.isin(*COMPARISONS), F.coalesce(F.when(_name(x), x), F.when(_name(y), y)))
    left_name, right_name = side(left["a0"], left["a1"], left["a2"]), side(_a(1), _a(2), _a(3))
    own_name = lambda c: F.element_at(F.split(c, r"\."), -1)
    across = word & (up == "OR") & ~_isin(left["up"], "AND", "OR", "NOT") & F.coalesce(own_name(left_name) != own_name(right_name), F.lit(False)) & ~_eq(right_end, "AND")
    position_ends = lambda c: c.isNull() | _isin(c, ",", "ASC", "DESC", "LIMIT", "OFFSET", "NULLS", ")", "HAVING", "ORDER", "UNION", "FETCH", "WINDOW", "FOR")
    position = own & (kind == "number") & _isin(_b(1), "BY", ",") & position_ends(_a(1))
    in_list = head & (F.col("q_opener.prev") == "IN")
    item = (F.col("depth") == 1) & _eq(first, "CREATE") & (F.col("block") == 1) & _isin(_b(1), "(", ",")
    create_table = _eq(F.col("second"), "TABLE") | _eq(F.col("third"), "TABLE")
    derived = head & _isin(q_opener["prev"], "FROM", ",") & _eq(outer["clause"], "FROM") & outer["own"]
    plain_where = _eq(clause, "WHERE") & in_query & (F.col("calls") == 0)
    like = word & up.isin("LIKE", "ILIKE") & _eq(_a(1), "'%'")
    rules = {
        "QL0100": (~mysql & (kind != "string") & expression & quoted_by("`"), here),
        "QL0101": ((src != "mssql") & expression & (F.length("tok") > 1) & quoted_by("["), here),
        "QL0102": (src.isin("mysql", "mariadb", "mssql") & (up == "::"), F.when(_eq(_b(1), ")"), before["pos"]).otherwise(pos - 1)),
        "QL0103": (~mysql & duplicate, whole),
        "QL0104": ((src == "mysql") & returning & first.isin("INSERT", "UPDATE", "DELETE"), whole),
        "QL0200": (returning & (((first == "INSERT") & lacks("returning_insert")) | ((first == "UPDATE") & lacks("returning_update")) | ((first == "DELETE") & lacks("returning_delete"))), whole),
        "QL0201": (duplicate & lacks("on_duplicate_key"), whole),
        "QL0202": (conflict & lacks("on_conflict"), whole),
        "QL0203": ((F.col("nth") == 1) & (first == "CREATE") & _eq(F.col("second"), "SEQUENCE") & lacks("create_sequence"), whole),
        "QL0300": (is_select & (F.col("n_from") > 1), whole),
        "QL0301": (is_select & (F.col("n_where") == 0) & (F.col("n_cross") > 0), whole),
        "QL0302": (is_join & natural, whole),
        "QL0303": (is_join & (F.col("has_on") == 0) & ~natural & ~_isin(_b(1), "CROSS", "SEMI", "ANTI", "ASOF", "STRAIGHT"), whole),
        "QL0304": (word & own & (up == "ON") & _eq(clause, "FROM") & (F.col("join_no") > 0) & taut, whole),
        "QL0305": ((kind == "quoted") & _eq(F.col("opener.prev"), "USING") & _eq(clause, "FROM"), whole),
        "QL0306": (mysql & is_join & (_eq(_b(1), "FULL") | (_eq(_b(1), "OUTER") & _eq(_b(2), "FULL"))), whole),
        "QL0307": (is_select & (F.col("n_from") > 1) & (F.col("n_joins") > 0), whole),
        "QL0400": (in_list & _eq(q_opener["prev2"], "NOT"), F.col("in_operand")),
        "QL0401": (in_list & ~_eq(q_opener["prev2"], "NOT") & (F.col("first_items") == 1) & (F.col("n_selects") == 1), F.col("in_operand")),
        "QL0402": (head & _isin(q_opener["prev"], "SELECT", ",", "DISTINCT", "ALL") & _eq(outer["clause"], "SELECT") & outer["own"] & (F.col("q_closer").isNull() | _isin(F.col("q_closer"), ",", "FROM", "AS", ")") | _name(F.col("q_closer"))), here),
        "QL0403": (head & (F.col("n_order") > 0) & (F.col("n_limit") == 0), whole),
        "QL0404": (is_select & F.coalesce(F.col("correlated"), F.lit(False)), F.col("where_operand")),
        "QL0500": ((up == "*") & own & _eq(clause, "SELECT") & (_isin(_b(1), "SELECT", "DISTINCT", "ALL", ",") | (_number(_b(1)) & _eq(_b(2), "TOP"))) & ~_isin(_a(1), "EXCEPT", "EXCLUDE", "REPLACE", "RENAME", "ILIKE"), here),
        "QL0501": (F.col("tok").endswith(".*") & own & _eq(clause, "SELECT"), whole),
        "QL0502": (like, operand),
        "QL0503": (compared & plain_where & (call_right | call_left), operand),
        "QL0504": (is_select & _eq(_a(1), "DISTINCT") & (F.col("n_joins") > 0), whole),
        "QL0505": (counts_column, here),
        "QL0506": (compared & ~assignment & ((_isin(_a(1), "'s'", "'%'") & single_left & _name(_b(1))) | (_isin(_b(1), "'s'", "'%'") & single_left & _name(_a(1)) & ~_eq(_a(2), "("))), operand),
        "QL0507": (across, F.col("chained")),
        "QL0600": (compared & up.isin("=", "<>", "!=") & ~assignment & (_eq(_a(1), "NULL") | (_eq(_b(1), "NULL") & single_left)), operand),
        "QL0601": ((F.col("nth") == 1) & (first == "UPDATE") & (F.col("s_where") == 0), whole),
        "QL0602": ((F.col("nth") == 1) & (first == "DELETE") & (F.col("s_where") == 0), whole),
        "QL0603": (word & (up == "OR") & ((F.col("n_and") > 0) | ((F.col("or_no") == 1) & (F.col("n_and_first") > 0))), F.col("chained")),
        "QL0604": (position & _eq(clause, "ORDER"), here),
        "QL0605": (is_select & (F.col("n_having") > 0) & (F.col("n_group") == 0), whole),
        "QL0606": (position & _eq(clause, "GROUP"), here),
        "QL0701": (derived & ~_eq(F.col("q_closer"), "AS") & ~_name(F.coalesce("q_closer", F.lit(""))), whole),
        "QL0704": (word & own & up.isin("LIMIT", "OFFSET") & (F.col("limit_no") == 1) & (F.col("n_order") == 0) & in_query, whole),
        "QL0801": (item & create_table & F.regexp_like(F.lower("tok"), F.lit(MONEY)) & _isin(_a(1), *FLOATS), here),
        "QL0802": (item & create_table & _isin(_a(1), "VARCHAR") & ~_eq(_a(2), "("), here),
    }
    rules = {r: (~raw & c, at) for r, (c, at) in rules.items()}
    starts = F.col("nth") == 1
    return rules | {"QL0001": (starts & raw, F.lit(None)), "QL0204": (starts & raw & dst.isNotNull() & (dst != "mariadb"), F.lit(None))}


def marked(of: DataFrame) -> DataFrame:
    """:func:`word_table` with counts, what the dialects lack, and facts about subqueries."""
    # A task's share of the words doesn't grow with them. The number of tasks is stated, as adaptive execution joins
    # tasks by the bytes of the shapes, which are few beside what the windows hold for them.
    n = of.agg(F.sum(F.size(F.split("shape", MARK)))).first()[0] or 0
    if n > TASK_WORDS:
        of = of.repartition(max(of.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_WORDS)), "sid")
    t = _with_sums(word_table(of))
    caps = dialect_caps(of.sparkSession)  # six rows
    t = t.join(F.broadcast(caps.withColumnsRenamed({c: f"to_{c}" for c in caps.columns})), F.col("target") == F.col("to_dialect"), "left")
    whole = Window.partitionBy("sid").orderBy("pos")
    query = Window.partitionBy("sid", "q_depth", "q_block")
    # The operand before [NOT] IN ( of a subquery, found at the parenthesis and read at the query's first words.
    t = t.withColumn("in_operand", F.lag("operand").over(whole))
    t = t.withColumns({"in_operand": F.first("in_operand").over(query.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "first_items": F.min(F.when((F.col("up") == "SELECT") & F.col("own"), F.col("n_items"))).over(query)})
    skip = F.when(~_isin(F.col("where_at.a1"), "(", "NOT", "EXISTS"), 1)
    for i in range(2, 7):
        skip = skip.when(~_isin(F.col(f"where_at.a{i}"), "(", "NOT", "EXISTS"), i)
    return t.withColumn("where_operand", F.col("where_at.pos") + skip.otherwise(6))


def _with_correlated(t: DataFrame) -> DataFrame:
    """``correlated`` at selects with a subquery in their WHERE whose own WHERE compares a qualified column; both out in the open, not in calls, lists or CASE."""
    a1 = _a(1)
    dotted = F.col("tok").contains(".") & F.col("kind").isin("word", "quoted") & ~_eq(a1, "(")
    taken = ~_isin(a1, "BETWEEN", "NOT", "LIKE", "ILIKE", "IN", "IS") & ~_isin(_b(1), "BETWEEN", "LIKE", "ILIKE") & ~F.exists(F.slice("before", 1, 3), lambda x: x == "BETWEEN")
    open_ = F.coalesce(F.col("outer.calls") == 0, F.lit(False)) & ~_isin(F.col("q_opener.prev"), "ANY", "ALL", "SOME", "BETWEEN", "LIKE") & ~F.coalesce(F.col("q_opener.call"), F.lit(False))
    inner = t.where(dotted & taken & (F.col("clause") == "WHERE") & (F.col("calls") == 0) & (F.col("q_depth") > 0) & (F.col("n_selects") == 1) & (F.col("outer.clause") == "WHERE") & open_)
    place = ["sid", "q_depth", "q_block", "select_no"]
    pointed = inner.select("sid", *(F.col(f"outer.{c}").alias(c) for c in place[1:])).distinct().withColumn("correlated", F.lit(True))
    pointed = pointed.withColumn("q_block", F.coalesce("q_block", F.lit(0)))
    return t.withColumn("q_block", F.coalesce("q_block", F.lit(0))).join(pointed, place, "left")


def shape_findings(of: DataFrame, rules: Collection[str]) -> tuple[DataFrame, DataFrame]:
    """``sid, rule, at, t_key, c_key, parts, detail`` of each finding in the tables of :func:`shapes`, and the columns of the tables they create.

    For rules that ask the catalog, t_key and c_key name the column; these findings are candidates only.
    """
    t = _with_correlated(stored(marked(of), "words"))
    wanted = {r: c for r, c in _rules(F.col("dialect"), F.col("target")).items() if r in rules}
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), at.cast("int").alias("at"))) for r, (c, at) in wanted.items())), lambda x: x.isNotNull()) if wanted else F.array().cast("array<struct<rule:string,at:int>>")
    hit = t.withColumn("found", found).where(F.size("found") > 0).withColumn("f", F.explode("found"))
    rule = F.col("f.rule")
    counted = F.when(_eq(_a(2), "DISTINCT"), _a(3)).otherwise(_a(2))
    # SELECT c FROM t: the one column of one relation.
    chosen = F.when((F.col("n_items") == 1) & (F.col("n_selects") == 1) & (F.col("up") == "SELECT") & _name(_a(1)) & (_eq(_a(2), "FROM") | _eq(_a(2), "AS")), _a(1))
    relation = F.when((F.col("n_from") == 1) & (F.col("n_joins") == 0), F.when(_eq(_a(2), "FROM"), _a(3)).when(_eq(_a(4), "FROM"), _a(5)))
    parts = name_parts(F.when(rule == "QL0505", counted).when(rule == "QL0400", chosen))
    of_name = F.when(F.size(parts) > 1, F.element_at(parts, F.size(parts) - 1)).when(rule == "QL0400", last_part(relation))
    # Of a dotted name the quoted part.
    pieces = F.regexp_extract_all("tok", F.lit(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+'), F.lit(0))
    of_quoted = F.when(rule.isin("QL0100", "QL0101"), F.array_position(F.transform(pieces, lambda x: x.startswith(F.when(rule == "QL0100", "`").otherwise("["))), True)).otherwise(0).cast("int")
    rows = hit.select("sid", rule.alias("rule"), F.col("f.at").alias("at"), of_name.alias("t_key"), F.when(F.size(parts) > 0, F.element_at(parts, -1)).alias("c_key"), of_quoted.alias("parts"), F.when(rule == "QL0300", F.concat(F.col("n_from").cast("string"), F.lit(" relations"))).alias("detail"))
    if "QL0900" in rules:
        rows = rows.unionByName(_used_columns(t))
    return rows, inline_columns(t)


def _used_columns(t: DataFrame) -> DataFrame:
    """Candidates of QL0900: columns of INSERT lists, and qualified columns with their relation."""
    place = ["sid", "q_depth", "q_block", "select_no"]
    t = t.where(~F.col("is_raw"))
    # A relation of a FROM: the name after FROM, JOIN or a comma, and the alias that follows it.
    starts = F.col("own") & (F.col("clause") == "FROM") & _isin(_b(1), "FROM", "JOIN", ",") & _name(F.col("up"))
    alias = F.when(_eq(_a(1), "AS"), _a(2)).when(_name(F.coalesce(_a(1), F.lit(""))), _a(1)).otherwise(F.col("tok"))
    scope = t.where(starts).select(*place, last_part(alias).alias("alias"), last_part(F.col("tok")).alias("t_key"), "pos")
    scope = scope.groupBy(*place, "alias").agg(F.min_by("t_key", "pos").alias("t_key"))
    dotted = F.col("tok").contains(".") & F.col("kind").isin("word", "quoted") & ~F.col("tok").endswith(".*") & ~_eq(_a(1), "(")
    used = (F.col("clause").isin("SELECT", "WHERE") | F.col("in_on")) & (F.col("calls") == F.when(_eq(F.col("opener.prev"), "IN"), 1).otherwise(0))
    names = name_parts(F.col("tok"))
    used = t.where(dotted & used & (F.col("select_no") > 0)).select(*place, F.col("pos").alias("at"), F.get(names, F.size(names) - 2).alias("alias"), F.get(names, F.size(names) - 1).alias("c_key"), F.size(names).alias("parts"))
    by_alias = used.where("parts = 2").join(scope, [*place, "alias"]).unionByName(used.where("parts > 2").withColumn("t_key", F.col("alias")))
    listed = (F.col("first") == "INSERT") & (F.col("depth") == 1) & (F.col("block") == 1) & _isin(_b(1), "(", ",") & _eq(F.col("clause"), "INTO") & _name(F.col("up"))
    inserted = t.where(listed).select("sid", F.col("pos").alias("at"), last_part(F.col("opener.prev")).alias("t_key"), last_part(F.col("tok")).alias("c_key"), F.lit(1).alias("parts"))
    both = by_alias.select("sid", "at", "t_key", "c_key", "parts").unionByName(inserted)
    return both.select("sid", F.lit("QL0900").alias("rule"), "at", "t_key", "c_key", "parts", F.concat_ws(".", "t_key", "c_key").alias("detail"))


def findings(docs: DataFrame, *, rules: Collection[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """``doc_id, stmt, rule, line, col, detail`` of each finding; detail says how many relations, which column or why raw. ``catalog`` has ``table_key, column_key, nullable``; tables that the texts create are added."""
    return _found(docs, rules, catalog).drop("dialect", "target")


def _found(docs: DataFrame, rules: Collection[str] | None, catalog: DataFrame | None) -> DataFrame:
    """:func:`findings` with the dialects, each mask linted once; an outer catalog knows names with their numbers."""
    texts = masked(docs, numbers=catalog is None)
    masks = stored(distinct_masks(texts), "masks")
    found = text_findings(masks, rules, catalog)
    # Of texts with runs, which aren't long, what stands before the finding in its line.
    lines = masks.select("doc_id", F.when(F.length("text") <= LONGEST_MASK, F.split("text", "\n")).alias("lines"))
    found = found.join(lines, "doc_id").withColumn("head", F.substring(F.get("lines", F.col("line") - 1), F.lit(1), F.col("col") - 1)).drop("lines").withColumnRenamed("doc_id", "mid")
    met = texts.join(stored(found, "found"), "mid")
    col = F.when(F.size("runs") > 0, F.length(unmasked(F.col("head"), F.col("runs"))) + 1).otherwise(F.col("col"))
    # Only details of this rule have parts of the text.
    detail = F.when(F.col("rule") == "QL0900", unmasked(F.col("detail"), F.col("runs"))).otherwise(F.col("detail"))
    return met.select("doc_id", "stmt", "rule", "line", col.alias("col"), detail.alias("detail"), "dialect", "target")


def text_findings(docs: DataFrame, rules: Collection[str] | None, catalog: DataFrame | None) -> DataFrame:
    """:func:`findings` of texts that are all different."""
    rules = selected() if rules is None else set(rules)
    stmts = statements(docs).where("status = 'ok' and kind <> 'UNKNOWN'").withColumn("sid", shape_id())
    # Read once for the shapes, once for the places; what isn't needed for these isn't written.
    kept = stored(stmts.select("doc_id", "dialect", "target", "is_raw", "real", "status", "kind", "shape", "sid", "stmt", "line", "lead", "start_line", "toks", "starts", "raw_reason"), "statements")
    rows, created = shape_findings(stored(shapes(kept), "shapes"), rules)
    rows = stored(rows, "findings")
    met = kept.select("sid", "doc_id", "stmt", "line", "lead", "start_line", "toks", "starts", "raw_reason").join(rows, "sid")
    if rules & set(CATALOG_RULES):
        inline = kept.select("sid", "doc_id").join(created, "sid").drop("sid")
        met = met.where(~F.col("rule").isin(*CATALOG_RULES)).unionByName(_by_catalog(met.where(F.col("rule").isin(*CATALOG_RULES)), inline, catalog))
    # Where the word stands: the breaks in the statement's pieces before it, and what follows the last.
    start = F.get("starts", F.col("at")) + 2 * (F.greatest(F.col("parts"), F.lit(1)) - 1)
    lead = F.array_join(F.slice("toks", 1, F.greatest(start - 1, F.lit(0))), "")
    raw = F.col("rule").isin("QL0001", "QL0204")
    line = F.when(raw, F.col("start_line")).otherwise(F.col("line") + F.length(lead) - F.length(F.translate(lead, "\n", "")))
    col = F.length(F.substring_index(lead, "\n", -1)) + 1 + F.when(F.instr(lead, "\n") == 0, F.col("lead")).otherwise(0)
    return met.select("doc_id", "stmt", "rule", line.cast("int").alias("line"), F.when(raw, 1).otherwise(col).cast("int").alias("col"), F.coalesce("detail", F.when(raw, F.col("raw_reason"))).alias("detail"))


def _by_catalog(found: DataFrame, inline: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Of findings about columns those that stand by what is known: by document and names for the tables that texts create, by names for the catalog.

    The inline columns are as many as the texts declare, and joined within their document, so equal table
    names in many documents don't meet.
    """
    columns = inline.select("doc_id", "table_key", "column_key", "nullable")
    declared = columns.groupBy("doc_id", F.col("table_key").alias("t_key"), F.col("column_key").alias("c_key")).agg(F.max("nullable").alias("in_nullable"))
    tables = declared.select("doc_id", "t_key").distinct().withColumn("in_table", F.lit(True))
    anywhere = declared.groupBy("doc_id", "c_key").agg(F.max("in_nullable").alias("in_any"))
    met = found.join(declared, ["doc_id", "t_key", "c_key"], "left").join(tables, ["doc_id", "t_key"], "left").join(anywhere, ["doc_id", "c_key"], "left")
    if catalog is not None:
        known = catalog.groupBy(F.col("table_key").alias("t_key"), F.col("column_key").alias("c_key")).agg(F.max("nullable").alias("out_nullable"))
        met = met.join(known, ["t_key", "c_key"], "left").join(known.select("t_key").distinct().withColumn("out_table", F.lit(True)), ["t_key"], "left")
        met = met.join(known.groupBy("c_key").agg(F.max("out_nullable").alias("out_any")), ["c_key"], "left")
    else:
        met = met.withColumns({c: F.lit(None).cast("boolean") for c in ("out_nullable", "out_table", "out_any")})
    # A table of the text's own goes before the catalog's of the same name.
    nullable = F.when(F.col("in_table"), F.col("in_nullable")).otherwise(F.col("out_nullable"))
    any_nullable = F.greatest("in_any", "out_any")
    safe = F.when(F.col("t_key").isNotNull(), ~nullable).otherwise((F.col("rule") == "QL0505") & ~any_nullable)
    known_table = F.coalesce("in_table", "out_table", F.lit(False))
    stays = F.when(F.col("rule") == "QL0900", known_table & nullable.isNull()).otherwise(~F.coalesce(safe, F.lit(False)))
    return met.where(stays).select(*found.columns)


def diagnostics(docs: DataFrame, *, rules: Collection[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Findings with what the rules' dimension says about them, and the dialects."""
    found = _found(docs, rules, catalog)
    described = found.join(F.broadcast(rules_table(docs.sparkSession)), "rule")  # 45 rows
    return described.select("doc_id", "stmt", "line", "col", "rule", "name", "category", "severity", "severity_rank", F.concat("message", F.coalesce(F.concat(F.lit(" ("), "detail", F.lit(")")), F.lit(""))).alias("message"), "suggestion", F.col("dialect").alias("source_dialect"), F.col("target").alias("target_dialect"))
