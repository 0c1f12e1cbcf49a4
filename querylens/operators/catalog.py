"""Schema catalogs from DDL."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.sources.work import stored

from .masks import LONGEST, mask_of, unmasked
from .tokens import MARK, kind_of, running, statements

CONSTRAINTS = ("PRIMARY", "FOREIGN", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "CHECK", "FULLTEXT", "SPATIAL", "LIKE", "PERIOD")


def plain_name(tok):
    """A name without its quotes."""
    return F.regexp_replace(tok, r"\A[\"`\[]|[\"`\]]\z", "")


def inline_columns(t: DataFrame) -> DataFrame:
    """``sid, table_key, column_key, nullable`` of the tables that statement shapes create, from their words; a table without a column list has none."""
    t = t.where((F.col("first") == "CREATE") & (F.col("depth") == 1) & (F.col("block") == 1) & ~F.col("is_raw"))
    of_table = F.coalesce((F.col("second") == "TABLE") | ((F.col("third") == "TABLE") & F.col("second").isin("TEMPORARY", "TEMP")), F.lit(False))
    t = t.where(of_table & ~F.coalesce(F.col("opener.query"), F.lit(False)))
    at = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("item", F.sum(F.col("tok").isin(",", "(").cast("int")).over(at))
    items = t.where("tok not in (',', '(')").groupBy("sid", "item").agg(
        F.first(F.col("opener.prev")).alias("table"), F.min_by("tok", "pos").alias("name"), F.min_by("up", "pos").alias("head"),
        F.max(((F.col("up") == "NOT") & (F.get("after", F.lit(0)) == "NULL")) | ((F.col("up") == "PRIMARY") & (F.get("after", F.lit(0)) == "KEY"))).alias("required"),
    )
    rows = items.where(~F.col("head").isin(*CONSTRAINTS, ")"))
    parts = F.regexp_extract_all("table", F.lit(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+'), F.lit(0))
    table = F.get(parts, F.size(parts) - 1)
    return rows.select("sid", F.lower(plain_name(table)).alias("table_key"), F.lower(plain_name(F.col("name"))).alias("column_key"), (~F.coalesce("required", F.lit(False))).alias("nullable"))


#: A row for each thing in a project's catalog, and for each note taken on the way.
ENTRIES = (
    "project_id string, kind string, db_key string, table_key string, name string, data_type string, nullable boolean, columns array<string>, "
    "`unique` boolean, `primary` boolean, fulltext boolean, spatial boolean, ref_db string, ref_table string, ref_columns array<string>, file_ord long, line int"
)

DDL = ("CREATE", "ALTER", "DROP", "USE")


def ddl_events(docs: DataFrame) -> DataFrame:
    """``project_id, file_ord, stmt, line, reason, toks`` of each statement; toks are the tokens of DDL, with their depth.

    ``docs`` has, besides what frames of SQL text have, ``project_id`` and ``file_ord``.
    """
    s = statements(docs.withColumn("doc_id", F.struct("project_id", "file_ord"))).where("status = 'ok'")
    tok = F.transform("sig", lambda i: F.element_at(F.col("toks"), i))
    depth = running(F.transform(tok, lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0)))
    cut = F.transform(F.arrays_zip(tok.alias("tok"), depth.alias("depth")), lambda x: F.struct(x["tok"].alias("tok"), F.when(kind_of(x["tok"], F.col("dialect")).isin("word"), F.upper(x["tok"])).otherwise(x["tok"]).alias("up"), kind_of(x["tok"], F.col("dialect")).alias("kind"), (x["depth"] + F.when(x["tok"] == "(", 1).otherwise(0)).alias("depth")))
    reason = F.when(F.col("is_raw"), F.concat(F.lit("raw:"), "raw_reason"))
    return s.select("doc_id.*", "stmt", F.col("start_line").cast("int").alias("line"), reason.alias("reason"), "head", F.when(~F.col("is_raw") & F.col("head").isin(*DDL), cut).alias("toks"))


def _unquoted(tok: str) -> str:
    return tok[1:-1] if tok[:1] in "\"`[" else tok


def _named(toks: list, at: int) -> tuple[list[str], int]:
    """The parts of the dotted name at this place, and the place after it; LookupError if there is none."""
    parts = [_unquoted(toks[at]["tok"])]
    at += 1
    while at + 1 < len(toks) and toks[at]["tok"] == ".":
        parts.append(_unquoted(toks[at + 1]["tok"]))
        at += 2
    return parts, at


def _inside(toks: list, at: int) -> tuple[list[list], int]:
    """The items between the parenthesis at this place and its match, and the place after it."""
    depth, items, start = toks[at]["depth"], [], at + 1
    for i in range(at + 1, len(toks)):
        if toks[i]["depth"] == depth and toks[i]["tok"] in (",", ")"):
            items.append(toks[start:i])
            start = i + 1
            if toks[i]["tok"] == ")":
                return [x for x in items if x], i + 1
    return [x for x in items if x], len(toks)


def _index_of(toks: list, *words: str) -> int:
    for i in range(len(toks) - len(words) + 1):
        if all(toks[i + k]["up"] == w for k, w in enumerate(words)):
            return i
    return -1


class Event(NamedTuple):
    """A statement of a project's DDL."""

    file_ord: int
    stmt: int
    line: int
    reason: str | None
    head: str | None
    toks: list | None


class _Fold:
    """One project's catalog while its statements are replayed in order."""

    def __init__(self) -> None:
        self.databases: dict[str, str] = {"": ""}
        self.tables: dict[tuple[str, str], dict] = {}
        self.current, self.notes = "", []

    def note(self, kind: str, name: str, event) -> None:
        self.notes.append((kind, name, event.file_ord, event.line))

    def key(self, parts: list[str]) -> tuple[str, str]:
        """One part belongs to the current database, the last two of several say where."""
        return (parts[-2].lower() if len(parts) > 1 else self.current, parts[-1].lower() if parts else "")

    def run(self, event: Event) -> None:
        """Replay a statement; one that is cut short or malformed leaves the catalog as it is, and a note."""
        try:
            self._run(event)
        except (LookupError, StopIteration, ValueError):
            self.note("malformed", " ".join(t["up"] for t in (event.toks or [])[:2]), event)

    def _run(self, event: Event) -> None:
        if event.reason:
            return self.note("skipped", event.reason, event)
        toks = list(event.toks) if event.toks is not None else []
        ups = [t["up"] for t in toks]
        if not toks:
            return self.note("skipped", event.head or "", event) if event.head not in ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE") else None
        words = [u for u in ups if u not in ("OR", "REPLACE", "TEMPORARY", "TEMP", "UNIQUE", "FULLTEXT", "SPATIAL")]
        what = words[1] if len(words) > 1 else ""
        exists = _index_of(toks, "IF", "NOT", "EXISTS") if ups[0] == "CREATE" else _index_of(toks, "IF", "EXISTS")
        at = (exists + (3 if ups[0] == "CREATE" else 2)) if exists > 0 else (ups.index(what) + 1 if what in ups else 1)
        if ups[0] == "USE":
            name = _named(toks, 2 if what in ("DATABASE", "SCHEMA") else 1)[0]
            self.databases.setdefault(name[-1].lower(), name[-1])
            self.current = name[-1].lower()
        elif ups[0] == "CREATE" and what in ("DATABASE", "SCHEMA"):
            name = _named(toks, at)[0]
            self.databases.setdefault(name[-1].lower(), name[-1])
        elif ups[0] == "CREATE" and what == "TABLE":
            self.create_table(toks, ups, at, exists > 0, event)
        elif ups[0] == "CREATE" and what == "INDEX":
            self.create_index(toks, ups, at, exists > 0, event)
        elif ups[0] == "ALTER" and what == "TABLE":
            self.alter_table(toks, at, exists > 0, event)
        elif ups[0] == "DROP" and what == "TABLE":
            while at < len(toks):
                parts, at = _named(toks, at)
                if self.tables.pop(self.key(parts), None) is None and exists < 0:
                    self.note("missing_table", ".".join(parts), event)
                at += 1
        elif ups[0] == "DROP" and what == "INDEX":
            name = _named(toks, at)[0][-1].lower()
            on = ups.index("ON") if "ON" in ups else -1
            table = self.tables.get(self.key(_named(toks, on + 1)[0])) if on > 0 else None
            if table:
                table["indexes"] = [i for i in table["indexes"] if (i["name"] or "").lower() != name]
        elif ups[0] == "DROP" and what in ("DATABASE", "SCHEMA"):
            gone = _named(toks, at)[0][-1].lower()
            self.databases.pop(gone, None)
            self.tables = {k: t for k, t in self.tables.items() if k[0] != gone}
            self.current = "" if self.current == gone else self.current
        else:
            self.note("skipped", f"{ups[0]} {what}".strip(), event)

    def create_table(self, toks, ups, at, if_not_exists, event) -> None:
        parts, at = _named(toks, at)
        key = self.key(parts)
        if key in self.tables:
            if if_not_exists:
                return
            if "REPLACE" not in ups[:3]:
                self.note("duplicate_table", ".".join(parts), event)
        self.databases.setdefault(key[0], parts[-2] if len(parts) > 1 else key[0])
        table = {"name": parts[-1], "columns": {}, "primary": [], "indexes": [], "foreign": []}
        like = _index_of(toks, "LIKE")
        if at < len(toks) and toks[at]["tok"] == "(" and toks[at + 1]["up"] != "LIKE":
            for item in _inside(toks, at)[0]:
                self.table_item(table, item)
        elif like > 0 and (source := self.tables.get(self.key(_named(toks, like + 1)[0]))):
            table |= {"columns": dict(source["columns"]), "primary": [*source["primary"]], "indexes": [dict(i) for i in source["indexes"]], "foreign": [dict(f) for f in source["foreign"]]}
        self.tables[key] = table

    def table_item(self, table, item) -> None:
        ups = [t["up"] for t in item]
        if ups[0] not in CONSTRAINTS:
            return self.column(table, item)
        name = _unquoted(item[1]["tok"]) if ups[0] == "CONSTRAINT" and item[1]["kind"] in ("word", "quoted") and ups[1] not in CONSTRAINTS else None
        if ups[0] == "CONSTRAINT":
            item, ups = (item[2:], ups[2:]) if name else (item[1:], ups[1:])
        open_ = next((i for i, u in enumerate(ups) if u == "("), -1)
        if open_ < 0 or ups[0] == "CHECK":
            return
        listed, after = _inside(item, open_)
        columns = ["".join(t["tok"] for t in x if t["up"] not in ("ASC", "DESC")) if len(x) > 1 else _unquoted(x[0]["tok"]) for x in listed]
        own = item[open_ - 1] if item[open_ - 1]["up"] not in (*CONSTRAINTS, "KEY") else None
        name = name or (_unquoted(own["tok"]) if own else None)
        if ups[0] == "FOREIGN":
            ref = _index_of(item, "REFERENCES")
            parts, at = _named(item, ref + 1)
            refs = [_unquoted(x[0]["tok"]) for x in _inside(item, at)[0]] if at < len(item) and item[at]["tok"] == "(" else []
            table["foreign"].append({"name": name, "columns": columns, "ref_db": parts[-2] if len(parts) > 1 else None, "ref_table": parts[-1], "ref_columns": refs})
            return
        primary = ups[0] == "PRIMARY"
        if primary:
            table["primary"] = columns
            for c in columns:
                if c.lower() in table["columns"]:
                    table["columns"][c.lower()] = table["columns"][c.lower()] | {"nullable": False}
        table["indexes"].append({"name": None if primary else name, "columns": columns, "unique": primary or ups[0] == "UNIQUE", "primary": primary, "fulltext": ups[0] == "FULLTEXT", "spatial": ups[0] == "SPATIAL"})

    def column(self, table, item) -> str:
        name = _unquoted(item[0]["tok"])
        ends = ("NOT", "NULL", "PRIMARY", "DEFAULT", "AUTO_INCREMENT", "UNIQUE", "REFERENCES", "COMMENT", "CHECK", "COLLATE", "GENERATED", "AS", "FIRST", "AFTER", "CONSTRAINT", "ON")
        stop = next((i for i, t in enumerate(item) if i and t["up"] in ends and t["depth"] == item[0]["depth"]), len(item))
        kind = ""
        for t in item[1:stop]:
            kind += (" " if kind and t["kind"] == "word" and not kind.endswith("(") else "") + t["tok"]
        primary = _index_of(item, "PRIMARY", "KEY") > 0
        table["columns"][name.lower()] = {"name": name, "data_type": kind, "nullable": not (primary or _index_of(item, "NOT", "NULL") > 0)}
        if primary:
            table["primary"] = [*table["primary"], name]
        return name

    def create_index(self, toks, ups, at, if_not_exists, event) -> None:
        on = ups.index("ON")
        parts, open_ = _named(toks, on + 1)
        table = self.tables.get(self.key(parts))
        if table is None:
            return self.note("missing_table", ".".join(parts), event)
        name = _unquoted(toks[at]["tok"]) if at < on else None
        # Held against the names as they are written, unlike all else.
        if if_not_exists and any(i["name"] == name for i in table["indexes"]):
            return None
        open_ = next(i for i in range(open_, len(ups)) if ups[i] == "(")
        columns = ["".join(t["tok"] for t in x if t["up"] not in ("ASC", "DESC")) if len(x) > 1 else _unquoted(x[0]["tok"]) for x in _inside(toks, open_)[0]]
        table["indexes"].append({"name": name, "columns": columns, "unique": "UNIQUE" in ups[:3], "primary": False, "fulltext": "FULLTEXT" in ups[:3], "spatial": "SPATIAL" in ups[:3]})
        return None

    def rename_in_keys(self, table, old: str, new: str) -> None:
        swap = lambda cs: [new if c.lower() == old.lower() else c for c in cs]
        table["primary"] = swap(table["primary"])
        table["indexes"] = [i | {"columns": swap(i["columns"])} for i in table["indexes"]]

    def alter_table(self, toks, at, if_exists, event) -> None:
        parts, at = _named(toks, at)
        key, rename = self.key(parts), None
        if key not in self.tables:
            return None if if_exists else self.note("missing_table", ".".join(parts), event)
        # Changed as a whole or, where a part is malformed, not at all.
        table = copy.deepcopy(self.tables[key])
        ops, start = [], at
        for i in range(at, len(toks) + 1):
            if i == len(toks) or (toks[i]["tok"] == "," and toks[i]["depth"] == 0):
                ops.append([t for t in toks[start:i]])
                start = i + 1
        for op in filter(None, ops):
            ups = [t["up"] for t in op]
            skip = 1 + (len(ups) > 1 and ups[1] == "COLUMN")
            guard = 3 if ups[skip : skip + 3] == ["IF", "NOT", "EXISTS"] else 2 if ups[skip : skip + 2] == ["IF", "EXISTS"] else 0
            rest = op[skip + guard :]
            if ups[0] == "RENAME" and ups[1] in ("TO", "AS"):
                rename = self.key(_named(op, 2)[0]), _named(op, 2)[0][-1]
            elif ups[0] in ("ADD", "DROP", "MODIFY", "CHANGE", "RENAME") and not rest and ups[1] not in ("PRIMARY", "INDEX", "KEY"):
                raise LookupError("nothing named")
            elif ups[0] == "RENAME" and rest and "TO" in ups:
                old, new = _unquoted(rest[0]["tok"]), _unquoted(op[ups.index("TO") + 1]["tok"])
                if old.lower() in table["columns"]:
                    table["columns"][new.lower()] = table["columns"].pop(old.lower()) | {"name": new}
                    self.rename_in_keys(table, old, new)
            elif ups[0] == "ADD" and ups[1] in CONSTRAINTS:
                self.table_item(table, op[1:])
            elif ups[0] == "ADD" and rest:
                for item in _inside(rest, 0)[0] if rest[0]["tok"] == "(" else [rest]:
                    if not (guard and _unquoted(item[0]["tok"]).lower() in table["columns"]):
                        self.column(table, item)
            elif ups[0] == "MODIFY" and rest:
                self.column(table, rest)
            elif ups[0] == "CHANGE" and len(rest) > 1:
                old = _unquoted(rest[0]["tok"])
                table["columns"].pop(old.lower(), None)
                self.rename_in_keys(table, old, self.column(table, rest[1:]))
            elif ups[0] == "DROP":
                self.drop_part(table, op, ups, rest)
            else:
                self.note("skipped", f"ALTER TABLE {ups[0]}", event)
        if rename:
            (new_key, name) = rename
            self.tables.pop(key)
            key, table = new_key, table | {"name": name}
        self.tables[key] = table
        return None

    def drop_part(self, table, op, ups, rest) -> None:
        name = _unquoted(op[-1]["tok"]).lower()
        if ups[1] == "PRIMARY":
            table["primary"] = []
            table["indexes"] = [i for i in table["indexes"] if not i["primary"]]
        elif ups[1] in ("CONSTRAINT", "FOREIGN", "INDEX", "KEY"):
            if ups[1] in ("CONSTRAINT", "FOREIGN"):
                table["foreign"] = [f for f in table["foreign"] if (f["name"] or "").lower() != name]
            if ups[1] in ("CONSTRAINT", "INDEX", "KEY"):
                table["indexes"] = [i for i in table["indexes"] if (i["name"] or "").lower() != name]
        elif rest:
            name = _unquoted(rest[0]["tok"]).lower()
            table["columns"].pop(name, None)
            table["primary"] = [c for c in table["primary"] if c.lower() != name]
            kept = [i | {"columns": [c for c in i["columns"] if c.lower() != name]} for i in table["indexes"]]
            table["indexes"] = [i for i in kept if i["columns"]]

    def rows(self) -> Iterable[dict]:
        for key, name in self.databases.items():
            if key or any(k[0] == "" for k in self.tables):
                yield {"kind": "database", "db_key": key, "name": name}
        for (db, key), t in self.tables.items():
            at = {"db_key": db, "table_key": key}
            yield at | {"kind": "table", "name": t["name"], "columns": t["primary"]}
            for c in t["columns"].values():
                yield at | {"kind": "column"} | c
            for i in t["indexes"]:
                yield at | {"kind": "index"} | i
            for f in t["foreign"]:
                yield at | {"kind": "foreign_key"} | f
        for kind, name, file_ord, line in self.notes:
            yield {"kind": "note", "name": name, "data_type": kind, "file_ord": file_ord, "line": line}


#: Texts of a project that is replayed once for all that differ from it in numbers alone, at most.
FILES = 64


def build_catalog(docs: DataFrame) -> DataFrame:
    """Replay the DDL of each project in order of file and statement: a row for each entry, as in ``ENTRIES``.

    Projects whose texts have the same mask, all together, leave the same behind but for their numbers: such
    texts are replayed once. A project of long or many texts is replayed for itself.
    """
    texts = docs.select("project_id", "file_ord", "dialect", F.translate(F.coalesce("text", F.lit("")), MARK, " ").alias("text"))
    of_project = Window.partitionBy("project_id")
    texts = texts.withColumn("small", (F.sum(F.length("text") + 1).over(of_project) <= LONGEST) & (F.count("*").over(of_project) <= FILES))
    small = texts.where("small").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("file_ord", "text", "dialect"))).alias("files"))
    small = small.select("project_id", "files", F.array_distinct("files.file_ord").alias("ords"), F.explode(F.array(mask_of(F.array_join("files.text", MARK)))).alias("m"))
    # Files of equal place keep it; an unknown place stays unknown.
    place = F.transform("files.file_ord", lambda x: F.array_position(F.col("ords"), x).cast("int") - 1)
    small = small.select("project_id", "ords", "m.*", F.col("files.dialect").alias("dialects"), place.alias("places"))
    listed = F.concat_ws("|", F.array_join("dialects", ",", "-"), F.array_join("places", ",", "-"), "mask")
    small = stored(small.withColumn("key", F.sha2(listed, 256)), "projects")
    unit = small.select("key", "dialects", "places", "mask").distinct().select("key", F.explode(F.arrays_zip(F.col("dialects").alias("dialect"), F.col("places").alias("place"), F.split("mask", MARK).alias("text"))).alias("f"))
    unit = unit.select(F.col("key").alias("project_id"), F.col("f.place").cast("long").alias("file_ord"), "f.dialect", "f.text")
    # Keys of large projects are none of a mask's.
    large_key = F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), "project_id"), F.lit("")))
    large = texts.where(~F.col("small"))
    units = unit.unionByName(large.select(large_key.alias("project_id"), "file_ord", "dialect", "text")).withColumn("target", F.lit(None).cast("string"))
    of_large = large.select("project_id").distinct().select("project_id", large_key.alias("key"), F.array().cast("array<string>").alias("runs"), F.lit(None).cast("array<long>").alias("ords"))
    entries = stored(replayed(units), "replayed").withColumnRenamed("project_id", "key")
    met = small.select("project_id", "key", "runs", "ords").unionByName(of_large).join(entries, "key")
    own = {c: unmasked(F.col(c), F.col("runs")) for c in ("db_key", "table_key", "name", "data_type", "ref_db", "ref_table")}
    own |= {c: F.transform(c, lambda x: unmasked(x, F.col("runs"))) for c in ("columns", "ref_columns")}
    own["file_ord"] = F.when(F.col("ords").isNull(), F.col("file_ord")).otherwise(F.get("ords", F.col("file_ord").cast("int")))
    return met.withColumns(own).select("project_id", *entries.columns[1:])


def replayed(docs: DataFrame) -> DataFrame:
    """Entries of projects by a replay of each.

    The replay is a fold: what a statement does depends on those before it (renames, LIKE, the current
    database). Projects are dealt to tasks and their statements stream through in order, in Arrow batches:
    of a project no more is held than its catalog. Only DDL brings its tokens along.
    """
    names = [c.strip().split(" ")[0].strip("`") for c in ENTRIES.split(", ")]
    empty = docs.sparkSession.createDataFrame([], ENTRIES).toArrow().schema
    order = ("project_id", "file_ord", "stmt")

    def rows(project: str | None, fold: _Fold) -> list[dict]:
        return [dict.fromkeys(names) | {"project_id": project} | r for r in fold.rows()]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, fold = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if fold is None or r["project_id"] != project:
                    if fold is not None:
                        out += rows(project, fold)
                    project, fold = r["project_id"], _Fold()
                fold.run(Event(*(r[c] for c in Event._fields)))
            yield pa.RecordBatch.from_pylist(out, schema=empty)
        if fold is not None:
            yield pa.RecordBatch.from_pylist(rows(project, fold), schema=empty)

    dealt = ddl_events(docs).select("project_id", *Event._fields).repartition("project_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(replay, ENTRIES)


def catalog_columns(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'column'").select("project_id", "db_key", "table_key", F.lower("name").alias("column_key"), "name", "data_type", "nullable")


def catalog_indexes(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'index'").select("project_id", "db_key", "table_key", "name", "columns", "unique", "primary", "fulltext", "spatial")


def catalog_foreign_keys(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'foreign_key'").select("project_id", "db_key", "table_key", "name", "columns", "ref_db", "ref_table", "ref_columns")


def catalog_notes(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'note'").select("project_id", F.col("data_type").alias("kind"), F.col("name").alias("subject"), "file_ord", "line")


NOTES = {
    "skipped": "is not replayed", "missing_table": "names a table that the catalog doesn't have", "duplicate_table": "creates a table that exists; the newer one counts", "malformed": "is cut short; nothing was changed",
}


def note_texts(entries: DataFrame) -> DataFrame:
    """``project_id, kind, subject, file_ord, line, text`` of each note: where and what, in words."""
    said = F.lit(None).cast("string")
    for kind, words in NOTES.items():
        said = F.when(F.col("kind") == kind, words).otherwise(said)
    return catalog_notes(entries).withColumn("text", F.concat(F.lit("file "), F.col("file_ord").cast("string"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), "subject", F.lit(" "), said))


def summary(entries: DataFrame) -> DataFrame:
    """``project_id, n_databases, n_tables, n_columns, n_indexes, n_foreign_keys, n_notes``."""
    kinds = {"database": "n_databases", "table": "n_tables", "column": "n_columns", "index": "n_indexes", "foreign_key": "n_foreign_keys", "note": "n_notes"}
    return entries.groupBy("project_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()))


VERSION = 1


def write_catalog(entries: DataFrame, path: str) -> None:
    """The catalog as a table that :func:`read_catalog` and ``findings(.., catalog=)`` take."""
    entries.withColumn("version", F.lit(VERSION)).write.mode("overwrite").partitionBy("version").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_catalog` wrote; ValueError for another version."""
    found = spark.read.schema(f"{ENTRIES}, version int").parquet(path)
    if not found.where(F.col("version") != VERSION).isEmpty():
        raise ValueError(f"the catalog at {path} isn't of version {VERSION}")
    return found.drop("version")


def known_columns(entries: DataFrame) -> DataFrame:
    """``table_key, column_key, nullable`` of a catalog, as lint asks it."""
    return catalog_columns(entries).select("table_key", "column_key", "nullable")


def merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two catalogs' entries, in order: of tables in both, the newer's; each database once; the notes of both."""
    table = ["project_id", "db_key", "table_key"]
    replaced = newer.where("kind = 'table'").select(*table)
    own = older.where("kind not in ('database', 'note')").join(replaced, table, "left_anti")
    databases = older.where("kind = 'database'").join(newer.where("kind = 'database'").select("project_id", "db_key"), ["project_id", "db_key"], "left_anti")
    notes = older.where("kind = 'note'").join(newer.where("kind = 'note'").select("project_id", "name", "data_type", "file_ord", "line").distinct(), ["project_id", "name", "data_type", "file_ord", "line"], "left_anti")
    return own.unionByName(databases).unionByName(notes).unionByName(newer)


def lookup(entries: DataFrame, wanted: DataFrame, current: str = "") -> DataFrame:
    """For ``project_id, name`` of unqualified tables: the current database's, the default one's, else the first by key."""
    tables = entries.where("kind = 'table'").select("project_id", "db_key", "table_key")
    rank = F.when(F.col("db_key") == current, 0).when(F.col("db_key") == "", 1).otherwise(2)
    met = wanted.withColumn("table_key", F.lower("name")).join(tables, ["project_id", "table_key"])
    best = F.row_number().over(Window.partitionBy("project_id", "name").orderBy(rank, "db_key", "table_key"))
    return met.withColumn("best", best).where("best = 1").drop("best")
