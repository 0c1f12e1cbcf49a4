"""SQL text as tables of statements and tokens.

A text is cut by one regular expression for each family of dialects, within the JVM, and its pieces
become statements in array functions on the document's own row: no shuffle. A statement's ``shape`` is
its significant words with literals replaced and dotted names as one word; statements of one shape
differ in nothing that rules look at, so what a word stands in (parentheses, query block, clause, join)
is found once for each distinct shape, by window functions that share one shuffle. Long texts, such as files,
are cut at the ends of statements into parts that are dealt to tasks: :func:`long_statements`.

Frames of SQL text have ``doc_id, dialect, target, text``; other columns are ignored. Null and empty
texts have no statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.sources.work import stored

_WORD = r"[A-Za-z_@\x{80}-\x{10FFFF}][A-Za-z0-9_$@#\x{80}-\x{10FFFF}]*+"
_NUMBER = r"(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"
_OPERATOR = r"::|<=>|<>|!=|<=|>=|\|\||:=|->>|->|&&"
_LINE, _BLOCK = r"--[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_SINGLE, _ESCAPED = r"[NnEe]?'(?:[^']|'')*+'?", r"[NnEe]?'(?:[^'\\]|\\.|'')*+'?"
_DOUBLE, _TICK, _BRACKET = r'"(?:[^"]|"")*+"?', r"`(?:[^`]|``)*+`?", r"\[[^\]]*+\]"
_DOLLAR = r"\$([A-Za-z_]*+)\$.*?\$\1\$"


def _pattern(*parts: str) -> str:
    return "(?s)" + "|".join((r"\s++", *parts, _NUMBER, _WORD, _OPERATOR, "."))


#: MariaDB's conditional comments lose their marks and keep their inside.
PATTERNS = {
    "mariadb": _pattern(r"/\*M?![0-9]*+", r"\*/", _LINE, r"#[^\n]*+", _BLOCK, _ESCAPED, _DOUBLE, _TICK),
    "mysql": _pattern(_LINE, r"#[^\n]*+", _BLOCK, _ESCAPED, _DOUBLE, _TICK),
    "postgres": _pattern(_LINE, _BLOCK, _DOLLAR, _SINGLE, _DOUBLE, _TICK),
    "other": _pattern(_LINE, _BLOCK, _SINGLE, _DOUBLE, _TICK, _BRACKET),
}

#: Words that begin a clause of a query block, in the block's order.
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "SET", "VALUES", "RETURNING", "UNION", "INTERSECT", "EXCEPT", "INTO", "UPDATE", "FETCH", "OFFSET", "WINDOW")
#: Words that are never a column's or an alias's name.
KEYWORDS = (*CLAUSES, "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "OUTER", "ON", "USING", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "BETWEEN", "EXISTS", "BY", "AS", "DISTINCT", "ALL", "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "TRUE", "FALSE", "INSERT", "DELETE", "CREATE", "TABLE", "WITH", "TOP")
#: First words of statements that are kept as they are known; others are raw.
STATEMENTS = ("ASSERT", "ATTACH", "CACHE", "CASE", "CLOSE", "COPY", "DEALLOCATE", "DECLARE", "DENY", "DESC", "DETACH", "END", "EXEC", "EXECUTE", "EXPORT", "FETCH", "FLUSH", "IF", "INSTALL", "KILL", "LISTEN", "LOAD", "NOTIFY", "OPEN", "PRAGMA", "PREPARE", "PRINT", "RAISE", "RAISERROR", "RELEASE", "RESET", "RETURN", "SAVEPOINT", "TABLE", "UNCACHE", "UNLISTEN", "UNLOAD", "VACUUM", "WHILE", "SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "USE", "SET", "BEGIN", "START", "COMMIT", "ROLLBACK", "SHOW", "TRUNCATE", "COMMENT", "EXPLAIN", "GRANT", "REVOKE", "VALUES", "MERGE", "REPLACE", "CALL", "ANALYZE", "DESCRIBE", "LOCK", "UNLOCK", "RENAME", "OPTIMIZE")


def _matches(patterns: dict[str, str], dialect: Column, text: Column) -> Column:
    chosen = F.regexp_extract_all(text, F.lit(patterns["other"]), F.lit(0))
    for name in ("mysql", "mariadb", "postgres"):
        chosen = F.when(dialect == name, F.regexp_extract_all(text, F.lit(patterns[name]), F.lit(0))).otherwise(chosen)
    return chosen


def pieces(dialect: Column, text: Column) -> Column:
    """All pieces of the text in order, white space and comments included: nothing is lost."""
    return _matches(PATTERNS, dialect, text)


def _is_space(tok: Column, dialect: Column) -> Column:
    """White space, comments, and the marks of conditional comments."""
    first = F.substring(tok, 1, 1)
    return first.isin(" ", "\n", "\t", "\r", "\f", "\x0b") | tok.startswith("--") | tok.startswith("/*") | ((first == "#") & dialect.isin("mysql", "mariadb")) | ((tok == "*/") & (dialect == "mariadb"))


def _is_string(tok: Column, dialect: Column) -> Column:
    first = F.substring(tok, 1, 1)
    return (first == "'") | (F.substring(F.upper(tok), 1, 2).isin("N'", "E'")) | (dialect.isin("mysql", "mariadb") & (first == '"')) | ((dialect == "postgres") & (first == "$") & (F.length(tok) > 1))


def _is_number(tok: Column) -> Column:
    return F.substring(tok, 1, 1).between("0", "9") | (tok.startswith(".") & F.substring(tok, 2, 1).between("0", "9"))


def kind_of(tok: Column, dialect: Column) -> Column:
    """string, quoted, number, word or sign, of a significant token or a word of a shape."""
    first = F.substring(tok, 1, 1)
    quoted = first.isin('"', "`") | ((first == "[") & (F.length(tok) > 1))
    return F.when(_is_string(tok, dialect), "string").when(quoted, "quoted").when(_is_number(tok), "number").when(F.regexp_like(tok, F.lit(r"\A[A-Za-z_@\x{80}-\x{10FFFF}]")), "word").otherwise("sign")


def running(counts: Column) -> Column:
    """Of an array of integers, the sum before each: in chunks, so that a long array isn't copied for each element."""

    def chunk(done: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(counts, at + 1, 1000), F.struct(done["total"].alias("total"), F.array().cast("array<int>").alias("sums")), lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["sums"], F.array(s["total"])).alias("sums")))
        return F.transform(F.array(inner), lambda s: F.struct(s["total"].alias("total"), F.concat(done["parts"], F.array(s["sums"])).alias("parts")))[0]

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("parts"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(counts) - 1, F.lit(0)), F.lit(1000)), start, chunk)["parts"])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once a row, however often it is used: expressions aren't merged across a generator."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


#: Texts that create stored programs, whose bodies hold semicolons.
PROGRAM = r"(?is)\bcreate\b[^;]*\b(?:procedure|function|trigger|event|package)\b.*\bbegin\b"


def _deltas(p: Column) -> Column:
    """Of each piece, 1 where it opens a body that semicolons may stand in, -1 where it closes one, else 0."""

    def delta(x: Column, i: Column) -> Column:
        up = F.upper(x)
        after = F.upper(F.coalesce(F.get(p, i + 2), F.lit("")))  # a space stands between
        before = F.upper(F.coalesce(F.get(p, i - 2), F.lit("")))
        opens = ((up == "BEGIN") & (F.coalesce(F.get(p, i + 1), F.lit(";")) != ";") & ~after.isin("TRANSACTION", "WORK")) | ((up == "CASE") & (before != "END"))
        closes = (up == "END") & ~after.isin("IF", "LOOP", "WHILE", "REPEAT", "FOR")
        return F.when(opens, 1).when(closes, -1).otherwise(0)

    return F.transform(p, delta)


def _ends(p: Column, program: Column, depth0: Column) -> Column:
    """Places (from 1) of the semicolons that end statements: those within BEGIN .. END of stored programs don't; ``depth0`` are open before."""
    ends = F.filter(F.transform(p, lambda x, i: F.when(x == ";", i + 1)), lambda i: i.isNotNull())
    outside = let(running(_deltas(p)), lambda depth: F.filter(ends, lambda i: F.element_at(depth, i) + depth0 <= 0))
    return F.when(program, outside).otherwise(ends)


#: Longer texts are cut into parts of this many pieces and those up to the end of the statement.
LONG, PART_PIECES = 20_000, 5_000
#: Words that tell, right behind a semicolon, what the word before it is: no part ends there.
TELLING = ("IF", "LOOP", "WHILE", "REPEAT", "FOR", "CASE")


def _part_patterns() -> dict[str, str]:
    end = ";(?!(?i:" + "|".join(TELLING) + "))"

    def of(pattern: str) -> str:
        piece = pattern.removeprefix("(?s)")
        again = piece.replace(r"\1", r"\2")  # the second dollar quote's own name
        return rf"(?s)(?:{piece}){{1,{PART_PIECES}}}+(?:(?!{end})(?:{again}))*+(?:;|\z)"

    return {name: of(pattern) for name, pattern in PATTERNS.items()}


#: What a part knows of the text before it: its line breaks, the characters in the line that the part begins in, the
#: bodies that are open; and whether the text creates stored programs.
PLACE = ("breaks0", "chars0", "depth0", "program")


def _breaks(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, "\n", ""))


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, dialect, target, text_id, part, text`` and :data:`PLACE`: long texts in parts that end where statements do, others whole.

    Cutting takes memory of a few times a text's length. A part has whole statements, so one statement's length
    bounds it as well. Equal texts of one document have one ``text_id``.
    """
    dialect, text = F.col("dialect"), F.col("text")

    def joined(cut: Column) -> Column:
        """Parts that end within a body together with those up to its end, and the depth before each."""

        def of(before: Column) -> Column:
            ends = F.array_union(F.filter(F.transform(before, lambda d, i: F.when((i > 0) & (d <= 0), i)), lambda i: i.isNotNull()), F.array(F.size(cut)))
            return let(ends, lambda e: F.transform(e, lambda to, j: let(F.when(j > 0, F.get(e, j - 1)).otherwise(0), lambda at: F.struct(F.array_join(F.slice(cut, at + 1, to - at), "").alias("text"), F.get(before, at).alias("depth0")))))

        return let(running(F.transform(cut, lambda x: let(pieces(dialect, x), lambda p: F.aggregate(_deltas(p), F.lit(0), lambda n, d: n + d)))), of)

    def placed(cut: Column, lens: Column, breaks: Column) -> Column:
        """The parts with their places; a line begins where the last part with a break has its last one."""

        def of(chars: Column, lines: Column, broken: Column) -> Column:
            ends = F.filter(F.transform(cut, lambda s, i: F.when(F.get(breaks, i) > 0, F.get(chars, i) + F.get(lens, i) - F.length(F.substring_index(s["text"], "\n", -1)))), lambda i: i.isNotNull())
            return let(ends, lambda e: F.transform(cut, lambda s, i: F.struct(s["text"].alias("text"), F.get(lines, i).alias("breaks0"), (F.get(chars, i) - F.coalesce(F.get(e, F.get(broken, i) - 1), F.lit(0))).alias("chars0"), s["depth0"].alias("depth0"))))

        return let(running(lens), lambda chars: let(running(breaks), lambda lines: let(running(F.transform(breaks, lambda n: F.when(n > 0, 1).otherwise(0))), lambda broken: of(chars, lines, broken))))

    alone = lambda cut: F.transform(cut, lambda x: F.struct(x.alias("text"), F.lit(0).alias("depth0")))
    cut = let(F.filter(_matches(_part_patterns(), dialect, text), lambda x: x != ""), lambda c: F.when(F.col("program"), joined(c)).otherwise(alone(c)))
    several = let(cut, lambda c: let(F.transform(c, lambda s: F.length(s["text"])), lambda lens: let(F.transform(c, lambda s: _breaks(s["text"])), lambda breaks: placed(c, lens, breaks))))
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("breaks0"), F.lit(0).alias("chars0"), F.lit(0).alias("depth0")))
    texts = docs.select("doc_id", "dialect", "target", F.translate(F.coalesce("text", F.lit("")), MARK, " ").alias("text"))
    texts = texts.withColumns({"program": F.regexp_like("text", F.lit(PROGRAM)), "text_id": F.sha2(F.concat_ws(MARK, F.coalesce(F.col("doc_id").cast("string"), F.lit(MARK)), F.coalesce("dialect", F.lit(MARK)), "text"), 256)})
    rows = texts.select("doc_id", "dialect", "target", "text_id", "program", F.posexplode(F.when(F.length("text") > LONG, several).otherwise(whole)).alias("part", "s"))
    return rows.select("doc_id", "dialect", "target", "text_id", "part", "s.text", "s.breaks0", "s.chars0", "s.depth0", "program")


#: Between the words of a shape; no text may hold it.
MARK = "\x01"
#: Clauses that stand where an operand must.
BROKEN = r"(?i)(?:^|\x01)(?:FROM|WHERE|HAVING|JOIN|SET)\x01(?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|SET)(?:\x01|$)|(?:^|\x01)(?:WHERE|HAVING|JOIN|AND|OR|BY)$"


def _statement_arrays(docs: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """``ids`` and ``stmts`` of rows that have :data:`PLACE`: the statements of each in order, in one array; work and memory grow with the text's length.

    What is read for each statement is a column that is evaluated once a row: within a function over an
    array, an expression would be evaluated again for each element.
    """
    dialect = F.col("dialect")
    cut = _once(docs.select(*ids, *PLACE, "text"), "p", pieces(dialect, F.col("text")))
    p = F.col("p")
    bounds = F.concat(F.array(F.lit(0)), _ends(p, F.col("program"), F.col("depth0")), F.array(F.size(p) + 1))
    cut = _once(cut, "cut", F.struct(bounds.alias("bounds"), running(F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)).alias("line_starts"))).select(*ids, "breaks0", "chars0", "p", "cut.*")
    at = lambda k: F.element_at(F.col("bounds"), k)
    toks = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.slice(p, at(k) + 1, at(k + 1) - at(k) - 1))
    cut = _once(cut, "toks", toks).select(*ids, "breaks0", "chars0", "line_starts", "toks")
    cut = _once(cut, "whole", F.transform("toks", lambda t: F.array_join(t, "")))
    # How many breaks stand before each statement, and how many characters before it in its first line.
    cut = _once(cut, "ran", F.struct(running(F.transform("whole", _breaks)).alias("before"), running(F.transform("whole", lambda t: F.length(t) + 1)).alias("chars")))
    cut = cut.select(*ids, "breaks0", "chars0", "line_starts", "toks", "whole", "ran.*")
    sig = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~_is_space(F.element_at(t, i), dialect))
    number = lambda x: _is_number(F.coalesce(x, F.lit("")))

    def words(xs: Column) -> Column:
        def plain(x: Column, k: Column) -> Column:
            word = lambda n: F.get(xs, k + n)
            wild = (F.substring(x, 2, 1) == "%") | ((F.substring(x, 2, 1) == "'") & (F.substring(x, 3, 1) == "%"))
            # Two numbers on both sides of = stay as they are: whether they are equal matters.
            equal = (F.coalesce(word(1) == "=", F.lit(False)) & number(word(2))) | (F.coalesce(word(-1) == "=", F.lit(False)) & number(word(-2)))
            return F.when(_is_string(x, dialect), F.when(wild, "'%'").otherwise("'s'")).when(_is_number(x) & ~equal, "0").otherwise(x)

        return F.transform(xs, plain)

    def unbalanced(words: Column) -> Column:
        """Whether parentheses don't match."""
        step = lambda d, x: let(d["now"] + F.when(x == "(", 1).otherwise(-1), lambda now: F.struct(now.alias("now"), F.least(d["least"], now).alias("least")))
        counted = lambda signs: let(F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), step), lambda d: (d["now"] != 0) | (d["least"] < 0))
        return let(F.filter(words, lambda x: x.isin("(", ")")), lambda signs: F.when(F.size(signs) == 0, False).otherwise(counted(signs)))

    def unclosed(x: Column) -> Column:
        """Whether a quote isn't closed."""
        open_ = lambda mark: (F.substring(x, -1, 1) != mark) | (F.length(x) == 1)
        first = F.substring(x, 1, 1)
        return F.when(first.isin("'", '"', "`"), open_(first)).when(F.substring(x, 1, 2).isin("N'", "n'", "E'", "e'"), open_(F.lit("'"))).otherwise(False)

    def shape_of(joined: Column) -> Column:
        # Dots join names, not what a parenthesis ends or begins.
        dotted = F.regexp_replace(joined, r"(?<![()])" + MARK + r"\.(?:" + MARK + r"\.)*" + MARK + r"(?![()])", ".")
        return F.when(F.contains(joined, F.lit(MARK + "." + MARK)), dotted).otherwise(joined)

    def starts_of(sig: Column, words: Column) -> Column:
        word = lambda k: F.get(words, k)
        glued = lambda k: F.coalesce((word(k) == ".") & (k > 0) & ~word(k - 1).isin("(", ")") & ~word(k + 1).isin("(", ")"), F.lit(False))
        found = F.filter(F.transform(sig, lambda i, k: F.when(~glued(k) & ~glued(k - 1), i)), lambda i: i.isNotNull())
        return F.when(F.array_contains(words, "."), found).otherwise(sig)

    def statement(t: Column, k: Column) -> Column:
        own_line = F.element_at(F.col("before"), k + 1) + 1
        line = own_line + F.col("breaks0")
        lead = F.element_at(F.col("chars"), k + 1) - F.element_at(F.col("line_starts"), own_line) + F.when(own_line == 1, F.col("chars0")).otherwise(0)
        sql = F.regexp_replace(F.element_at(F.col("whole"), k + 1), r"\A\s+|\s+\z", "")
        # White space at the beginning is one piece.
        blank = F.when((F.size(t) > 1) & (F.trim(F.get(t, F.lit(0)), F.lit(" \t\n\r")) == ""), _breaks(F.get(t, F.lit(0)))).otherwise(0)

        def judged(sig: Column, xs: Column, words: Column, shape: Column, sql: Column) -> Column:
            return F.struct(
                line.alias("line"), lead.alias("lead"), t.alias("toks"), sig.alias("sig"), starts_of(sig, words).alias("starts"), shape.alias("shape"), sql.alias("sql"), F.upper(F.get(words, F.lit(0))).alias("head"),
                (line + blank).alias("start_line"), (F.size(sig) > 0).alias("real"), (sql != "").alias("some"),
                (unbalanced(words) | F.exists(xs, unclosed) | F.regexp_like(shape, F.lit(BROKEN))).alias("broken"),
            )

        own = F.when(F.size(t) > 0, sig(t)).otherwise(F.array().cast("array<int>"))
        return let(own, lambda g: let(F.transform(g, lambda i: F.element_at(t, i)), lambda xs: let(words(xs), lambda w: let(shape_of(F.array_join(w, MARK)), lambda shape: let(sql, lambda q: judged(g, xs, w, shape, q))))))

    return cut.select(*ids, F.transform("toks", statement).alias("stmts"))


#: Fixed values, in the order in which they are tried: why a statement of MariaDB is kept as raw text, by what its
#: upper-case text begins with or holds.
RAW_REASONS = (
    ("system_versioning", None, ("WITH SYSTEM VERSIONING", "PERIOD FOR SYSTEM_TIME")),
    ("temporal_query", None, ("FOR SYSTEM_TIME",)),
    ("create_package", r"CREATE (OR REPLACE )?PACKAGE", ()),
    ("sequence_options", r"CREATE (OR REPLACE )?SEQUENCE", ()),
    ("vector_type", None, ("VECTOR(", "VEC_DISTANCE")),
    ("delimiter", "DELIMITER", ()),
    ("stored_program_body", r"CREATE (TRIGGER|FUNCTION|PROCEDURE)", ()),
    ("optimization_hint", "ALTER TABLE", (" DISABLE KEYS", " ENABLE KEYS")),
    ("definer_clause", r"CREATE (DEFINER|ALGORITHM)=", ()),
    ("definer_clause", None, ("DEFINER=`",)),
    ("create_event", "CREATE EVENT", ()),
)


def raw_reason(text: Column) -> Column:
    """Why a statement of MariaDB is kept as raw text; the first reason that applies."""

    def of(head: Column) -> Column:
        found = F.lit("unrepresented")
        for name, start, held in reversed(RAW_REASONS):
            begins = F.regexp_like(head, F.lit(r"\A" + start)) if start else F.lit(True)
            holds = F.lit(not held)
            for h in held:
                holds |= F.contains(head, F.lit(h))
            found = F.when(begins & holds, name).otherwise(found)
        return found

    return let(F.regexp_replace(F.ltrim(F.upper(text)), r"\A/\*M?![0-9]*\s*", ""), of)


FIELDS = ("line", "lead", "toks", "sig", "starts", "shape", "sql", "head", "start_line", "real", "some", "broken")


def _judged(docs: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The statements of :func:`_statement_arrays` with what each is by itself, and what its text is by them."""
    mariadb = F.col("dialect") == "mariadb"

    def reasoned(s: Column) -> Column:
        return F.struct(*(s[c].alias(c) for c in FIELDS), F.when(mariadb, raw_reason(s["sql"])).alias("reason"))

    def judged(s: Column) -> Column:
        plain_sequence = (s["reason"] == "sequence_options") & F.regexp_like(F.upper(s["sql"]), F.lit(r"\ACREATE SEQUENCE [^ ]+( START WITH [0-9]+| INCREMENT BY [0-9]+| MINVALUE [0-9]+| MAXVALUE [0-9]+| CACHE [0-9]+)*\z"))
        known = F.coalesce(s["head"].isin(*STATEMENTS, "("), F.lit(False))
        own = F.coalesce(mariadb & (s["broken"] | ~known | ((s["reason"] != "unrepresented") & ~plain_sequence)), F.lit(False))
        return F.struct(*(s[c].alias(c) for c in (*FIELDS, "reason")), own.alias("is_raw"), known.alias("known"))

    rows = _once(_statement_arrays(docs, ids).withColumnRenamed("stmts", "cut"), "stmts", F.transform(F.transform("cut", reasoned), judged)).drop("cut")
    rows = _once(rows, "some_raw", mariadb & F.exists("stmts", lambda s: s["is_raw"] & s["real"]))
    return rows.withColumn("failed", ~mariadb & F.exists("stmts", lambda s: s["broken"] & s["real"]))


def _named(rows: DataFrame) -> DataFrame:
    """Statements with their kind and, where they are raw, the reason."""
    kind = F.when(F.col("is_raw"), "RAW").when(F.col("known"), F.col("head")).otherwise("UNKNOWN")
    return rows.withColumns({"kind": kind, "raw_reason": F.when(F.col("is_raw"), F.col("reason"))}).drop("known", "reason", "some")


def _status(failed: str) -> Column:
    return F.when(F.col(failed), "parse_error").otherwise("ok").alias("status")


def statements(docs: DataFrame) -> DataFrame:
    """``doc_id, dialect, target, stmt, sql, kind, is_raw, raw_reason, start_line, status`` and what a statement is made of; empty ones are skipped.

    There is no grammar: MariaDB's own statements are recognised by :func:`raw_reason`. An unclosed quote,
    an unmatched parenthesis or a clause without its operand makes a statement raw in MariaDB and the whole
    document's status ``parse_error`` elsewhere, as a document is taken whole there. An unknown first word
    makes a statement raw in MariaDB; elsewhere its kind is UNKNOWN and no rule applies to it.

    ``toks`` are all pieces of its text, ``sig`` the places of the significant ones, ``starts`` those where
    the words of ``shape`` begin; its first piece stands in ``line``, behind ``lead`` characters.

    A text is taken whole, with all its pieces in memory; for files see :func:`long_statements`.
    """
    text = F.translate(F.coalesce("text", F.lit("")), MARK, " ")
    none = {c: F.lit(0) for c in PLACE[:-1]}
    whole = docs.select("doc_id", "dialect", "target", text.alias("text")).withColumns({**none, "program": F.regexp_like("text", F.lit(PROGRAM))})
    judged = _judged(whole, ("doc_id", "dialect", "target"))
    # A piece of comments alone is no statement, but on MariaDB's way by pieces.
    kept = judged.select("doc_id", "dialect", "target", _status("failed"), F.filter("stmts", lambda s: s["real"] | (F.col("some_raw") & s["some"])).alias("kept"))
    rows = kept.select("doc_id", "dialect", "target", "status", F.posexplode("kept").alias("stmt", "s"))
    return _named(rows.select("doc_id", "dialect", "target", "status", "stmt", "s.*"))


#: What :func:`statements` says of each statement, but for its number and its text's status.
COLUMNS = (*(f for f in FIELDS if f != "some"), "is_raw", "kind", "raw_reason")


#: About how many statements of long texts a task joins to what is known of their texts.
TASK_ROWS = 250_000


def long_statements(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``doc_id, dialect, target, status, stmt`` and the given columns of :func:`statements`, of texts of many statements.

    A task holds the statements of one of their :func:`parts` at a time. Their columns are written, as what
    the parts of a text say of the whole text is joined to them.
    """
    ids, key = ("doc_id", "dialect", "target", "text_id", "part"), ("text_id", "part")
    # A stated number of tasks isn't made smaller for texts that compress well.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = _judged(parts(docs).repartition(tasks, *key), ids)
    kept = judged.select(*ids, "some_raw", "failed", F.filter("stmts", lambda s: s["real"] | s["some"]).alias("kept"))
    # The place of each among all, and among those that are more than comments.
    numbered = let(running(F.transform("kept", lambda s: s["real"].cast("int"))), lambda reals: F.transform("kept", lambda s, i: F.struct(s.alias("s"), F.get(reals, i).alias("nth_real"))))
    n_real = F.size(F.filter("kept", lambda s: s["real"])).alias("n_real")
    rows = kept.select(*ids, "some_raw", "failed", n_real, F.size("kept").alias("n_some"), F.posexplode(numbered).alias("nth_some", "x"))
    rows = _named(rows.select(*ids, "some_raw", "failed", "n_real", "n_some", "nth_some", "x.nth_real", "x.s.*")).withColumn("is_real", F.col("real"))
    own = ("some_raw", "failed", "n_real", "n_some")
    rows = stored(rows.select(*ids, *own, "nth_some", "nth_real", "is_real", *columns), "statements")
    text = Window.partitionBy("text_id")
    before = text.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    facts = rows.select(*key, *own).distinct().select(*key, F.max("some_raw").over(text).alias("text_raw"), F.max("failed").over(text).alias("text_failed"), n_before("n_real").alias("real_before"), n_before("n_some").alias("some_before"))
    dealt = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), *key)
    told = dealt.join(facts, [*key]).where("is_real or text_raw")
    stmt = F.when(F.col("text_raw"), F.col("some_before") + F.col("nth_some")).otherwise(F.col("real_before") + F.col("nth_real"))
    return told.select("doc_id", "dialect", "target", _status("text_failed"), stmt.alias("stmt"), *columns)


def shape_id() -> Column:
    return F.sha2(F.concat_ws(MARK, "dialect", F.coalesce("target", F.lit(MARK)), F.col("is_raw").cast("string"), "shape"), 256)


def shapes(stmts: DataFrame) -> DataFrame:
    """``sid, dialect, target, is_raw, shape`` of the distinct shapes of statements; equal ones collapse before the shuffle."""
    return stmts.where("status = 'ok' and kind <> 'UNKNOWN' and real").select(shape_id().alias("sid"), "dialect", "target", "is_raw", "shape").distinct()


#: Words that may stand before a parenthesis without calling anything; LEFT and RIGHT also name functions.
NO_CALL = (*(k for k in KEYWORDS if k not in ("LEFT", "RIGHT")), "ANY", "SOME", "OVER", "KEY", "INDEX", "REFERENCES", "CHECK")
#: Operands of conditions begin after one of these.
LOGIC = ("SELECT", "FROM", "WHERE", "HAVING", "ON", "AND", "OR", "WHEN", "THEN", "ELSE", "CASE", "BY", "SET", "VALUES", "RETURNING", "DISTINCT", "ALL", "UNION", "LIMIT", "OFFSET", "AS", "USING", ",")
REACH = 9


def word_table(shapes: DataFrame) -> DataFrame:
    """Each word of each shape with what stands around it, for the tables of :func:`shapes`.

    ``depth`` and ``block`` number the parentheses that a word stands in (a parenthesis belongs to its own
    inside), ``q_depth`` and ``q_block`` those of them that hold queries: what is in grouping parentheses or
    a call's arguments belongs to the query around them. ``own`` words stand directly in their query;
    ``calls`` counts the calls, lists and CASEs between a word and its query. ``clause``, ``select_no`` and
    ``join_no`` say where in the query, ``opener`` what stands before and ``closer`` what stands after the
    parentheses, ``q_opener`` and ``q_closer`` the query's; ``outer`` is where the query itself stands.
    ``operand`` is where the operand of a condition that a word ends or joins begins, ``chain`` the same for
    a chain of AND and OR; ``last`` and ``next`` are the boundaries on both sides.
    """
    words = shapes.withColumn("words", F.split("shape", MARK)).drop("shape")
    t = words.select("sid", "dialect", "target", "is_raw", "words", F.posexplode("words").alias("pos", "tok"))
    near = lambda c: F.transform(c, lambda x: F.when(F.substring(x, 1, 1).isin("'", '"', "`", "["), x).otherwise(F.upper(x)))
    back = F.reverse(F.slice("words", F.greatest(F.col("pos") - REACH + 1, F.lit(1)), F.least(F.col("pos"), F.lit(REACH))))
    t = t.select(
        "sid", "dialect", "target", "is_raw", "pos", "tok", kind_of(F.col("tok"), F.col("dialect")).alias("kind"), near(back).alias("before"), near(F.slice("words", F.col("pos") + 2, REACH)).alias("after"),
        F.upper(F.get("words", F.lit(0))).alias("first"), F.upper(F.get("words", F.lit(1))).alias("second"), F.upper(F.get("words", F.lit(2))).alias("third"),
    )
    b, a = (lambda i: F.get("before", F.lit(i))), (lambda i: F.get("after", F.lit(i)))
    is_ = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    up = F.when(F.col("kind") == "word", F.upper("tok")).otherwise(F.col("tok"))
    t = t.withColumn("up", up)
    is_open, is_close, word = F.col("tok") == "(", F.col("tok") == ")", F.col("kind") == "word"
    whole = Window.partitionBy("sid").orderBy("pos")
    until, earlier = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    n = lambda c: F.sum(c.cast("int"))
    t = t.withColumn("depth", (n(is_open).over(whole.rowsBetween(*until)) - F.coalesce(n(is_close).over(whole.rowsBetween(*earlier)), F.lit(0))).cast("int"))
    t = t.withColumn("block", n(is_open).over(Window.partitionBy("sid", "depth").orderBy("pos").rowsBetween(*until)).cast("int"))
    inside = Window.partitionBy("sid", "depth", "block").orderBy("pos")
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    name = ~is_(up, *KEYWORDS) & F.col("kind").isin("word", "quoted")
    call = F.coalesce(F.regexp_like(b(0), F.lit(r"\A[A-Z_@`\"\[\x{80}-\x{10FFFF}]")), F.lit(False)) & ~is_(b(0), *NO_CALL)
    t = t.withColumns({
        "opener": F.first(F.struct("pos", b(0).alias("prev"), b(1).alias("prev2"), a(0).alias("head"), is_(a(0), "SELECT", "WITH", "VALUES").alias("query"), call.alias("call"))).over(inside.rowsBetween(*until)),
        "closer": F.last(a(0)).over(inside.rowsBetween(*everything)),
        # Whether an argument is a column's name alone.
        "bare": F.max(name & (is_(b(0), "(", ",") | (is_(b(0), "DISTINCT") & is_(b(1), "("))) & is_(a(0), ")", ",")).over(inside.rowsBetween(*everything)),
    })
    query, apart = F.coalesce(F.col("opener.query"), F.lit(False)) & (F.col("depth") > 0), F.coalesce(F.col("opener.call") | F.col("opener.prev").isin("IN", "OVER", "ANY", "SOME", "ALL"), F.lit(False)) & (F.col("depth") > 0)
    case, end = word & (up == "CASE"), word & (up == "END")
    t = t.withColumns({
        "q_depth": (n(is_open & query).over(whole.rowsBetween(*until)) - F.coalesce(n(is_close & query).over(whole.rowsBetween(*earlier)), F.lit(0))).cast("int"),
        "all_calls": (n((is_open & apart & ~query) | case).over(whole.rowsBetween(*until)) - F.coalesce(n((is_close & apart & ~query) | end).over(whole.rowsBetween(*earlier)), F.lit(0))).cast("int"),
        "call_after": F.lead(F.struct("bare", "closer", call.alias("call")), 2).over(whole), "call_before": F.lag(F.struct("opener.pos", "bare", "opener.call", is_close.alias("closes"))).over(whole),
        "nth": F.row_number().over(whole),
    })
    t = t.withColumn("q_block", n(is_open & query).over(Window.partitionBy("sid", "q_depth").orderBy("pos").rowsBetween(*until)).cast("int"))
    of_query = Window.partitionBy("sid", "q_depth", "q_block").orderBy("pos")
    t = t.withColumns({
        "own": F.col("depth") == F.first("depth").over(of_query.rowsBetween(*until)), "calls": F.col("all_calls") - F.first("all_calls").over(of_query.rowsBetween(*until)),
        "q_opener": F.first("opener").over(of_query.rowsBetween(*until)), "q_closer": F.last("closer").over(of_query.rowsBetween(*everything)),
    })
    begins = word & F.col("own") & up.isin(*CLAUSES) & ~((up == "UPDATE") & is_(b(0), "DO", "FOR", "ON")) & ~((up == "SET") & is_(b(0), "CHARACTER", "ON"))
    t = t.withColumns({
        "select_no": n(word & F.col("own") & (up == "SELECT")).over(of_query.rowsBetween(*until)).cast("int"),
        "clause": F.last(F.when(begins, up), ignorenulls=True).over(of_query.rowsBetween(*until)),
        "clause_no": n(begins).over(of_query.rowsBetween(*until)).cast("int"),
    })
    of_select = Window.partitionBy("sid", "q_depth", "q_block", "select_no").orderBy("pos")
    in_from = F.col("own") & (F.col("clause") == "FROM")
    t = t.withColumns({
        "join_no": n(F.coalesce(word & (up == "JOIN") & in_from, F.lit(False))).over(of_select.rowsBetween(*until)).cast("int"),
        "in_on": F.coalesce(F.last(F.when(in_from & (up == "ON"), True).when(in_from & up.isin("JOIN", ",", "USING"), False), ignorenulls=True).over(of_select.rowsBetween(*until)), F.lit(False)) & (F.col("clause") == "FROM"),
        "around": F.lag(F.struct("q_depth", "q_block", "select_no", "clause", "own", "calls")).over(whole),
    })
    infix = (up == "NOT") & is_(a(0), "LIKE", "ILIKE", "IN", "BETWEEN", "REGEXP", "RLIKE")
    between = (up == "AND") & F.exists(F.slice("before", 1, 5), lambda x: x == "BETWEEN")
    edge = ((word & up.isin(*LOGIC, "NOT")) | (up == ",")) & ~infix & ~between
    spot = F.struct("pos", "up", a(0).alias("a0"), a(1).alias("a1"), a(2).alias("a2"))
    t = t.withColumn("around", F.first("around").over(of_query.rowsBetween(*until))).withColumnRenamed("around", "outer")
    t = t.withColumns({
        "last": F.coalesce(F.last(F.when(edge | is_open, spot), ignorenulls=True).over(inside.rowsBetween(*earlier))),
        "chain": F.last(F.when((edge & ~up.isin("AND", "OR", "NOT")) | is_open, spot), ignorenulls=True).over(inside.rowsBetween(*earlier)),
        "next": F.first(F.when(edge, up), ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
    })
    # Grouping parentheses at its beginning and NOT don't count as a part of an operand.
    skipped = lambda s: F.when(s["a0"].isin("(", "NOT"), F.when(s["a1"].isin("(", "NOT"), s["pos"] + 3).otherwise(s["pos"] + 2)).otherwise(s["pos"] + 1)
    return t.withColumns({"operand": F.coalesce(skipped(F.col("last")), F.lit(0)), "chained": F.coalesce(skipped(F.col("chain")), F.lit(0))})
