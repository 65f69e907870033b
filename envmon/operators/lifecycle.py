"""Table lifecycle as set operations: upsert (S3), insert-ignore (S4),
cascade delete (S5) and constraint checks (R7).

The source changes one row per call inside a transaction.  Here a whole
change set is applied in one job, and the result is a new version of each
table (written elsewhere, never over the files being read).
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..schemas import ENUMS, FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS

Tables = Mapping[str, DataFrame]


# -- S3 ----------------------------------------------------------------------
def upsert_snapshot(base: DataFrame, changes: DataFrame, key: str | Sequence[str],
                    order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``changes`` (rows with new values) to ``base`` by key.

    Returns (new table, change keys that matched no row).  Columns missing
    from ``changes`` keep their old value.  With several changes for one key
    the one with the largest ``order_by`` wins (of equal ones the largest
    values), an aggregate, max of a struct, so a key with very many changes is
    combined map-side.  Without ``order_by`` the row of the largest values wins:
    a rerun gives the same table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    upd_cols = [c for c in changes.columns if c in base.columns and c not in keys]
    first = [] if order_by is None else [F.col(order_by).alias("__o")]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*first, *[F.col(c) for c in upd_cols])).alias("__s"))
    changes = last.select(*keys, *[F.col(f"__s.{c}").alias(c) for c in upd_cols])
    ch = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in upd_cols],
                        F.lit(True).alias("__hit"))
    j = base.join(ch, keys, "left")
    out = j.select(*[
        (F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in upd_cols else F.col(c)).alias(c)
        for c in base.columns])
    unmatched = changes.select(*keys).join(base.select(*keys), keys, "left_anti")
    return out, unmatched


# -- S4 ----------------------------------------------------------------------
def insert_ignore(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add the rows of ``new`` whose key is not in ``base`` (and not repeated in ``new``)."""
    keys = list(key)
    add = new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(add.select(*base.columns))


# -- S5 ----------------------------------------------------------------------
# parent table -> dependent tables: (child, child fk column, parent key column)
CASCADE: dict[str, list[tuple[str, str, str]]] = {
    "regions": [("sensors", "region_id", "region_id"), ("alerts", "region_id", "region_id"),
                ("resources", "region_id", "region_id"), ("devices", "install_region_id", "region_id")],
    "sensors": [("sensor_readings", "sensor_id", "sensor_id")],
    "alert_rules": [("alerts", "rule_id", "rule_id")],
    "alerts": [("notifications", "alert_id", "alert_id")],
    "resources": [("resource_changes", "resource_id", "resource_id")],
    "devices": [("device_status_logs", "device_id", "device_id"),
                ("maintenance_records", "device_id", "device_id")],
    "report_templates": [("reports", "template_id", "template_id")],
    "roles": [("user_roles", "role_id", "role_id"), ("role_permissions", "role_id", "role_id")],
    "permissions": [("role_permissions", "permission_id", "permission_id")],
    "users": [("user_roles", "user_id", "user_id")],
}


def doomed_rows(tables: Tables, parent: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The rows to delete per table: the given parents and everything that depends on them.

    A table's rows are found by their foreign keys, one semi join per parent, as a plan only:
    nothing is written, and a fact meets the (few) deleted parents, never itself.
    """
    pk = PRIMARY_KEYS[parent]
    out = {parent: tables[parent].join(keys.select(*pk).dropDuplicates(), pk, "left_semi")}
    for child, links in _dependents(tables, parent).items():
        hit = [tables[child].join(out[p].select(F.col(pkey).alias(fk)).dropDuplicates(), fk, "left_semi")
               for p, fk, pkey in links]
        rows = hit[0]
        for more, (p, fk, pkey) in zip(hit[1:], links[1:]):  # a row with two deleted parents counts once
            rows = rows.unionByName(_without(more, out, links[:links.index((p, fk, pkey))]))
        out[child] = rows
    return out


def _dependents(tables: Tables, parent: str) -> dict[str, list[tuple[str, str, str]]]:
    """child table -> (parent table, fk column, parent key) of every deleted parent, parents first."""
    reached, order = {parent}, [parent]
    for t in order:
        for child, _, _ in CASCADE.get(t, []):
            if child in tables and child not in reached:
                reached.add(child)
                order.append(child)
    links: dict[str, list[tuple[str, str, str]]] = {}
    for p in order:
        for child, fk, pkey in CASCADE.get(p, []):
            if child in reached:
                links.setdefault(child, []).append((p, fk, pkey))
    done, out = {parent}, {}
    while len(out) < len(links):  # a table comes after all its parents
        for child, ps in links.items():
            if child not in out and all(p in done for p, _, _ in ps):
                out[child] = ps
                done.add(child)
    return out


def _without(rows: DataFrame, doomed: Mapping[str, DataFrame], links) -> DataFrame:
    for p, fk, pkey in links:
        rows = rows.join(doomed[p].select(F.col(pkey).alias(fk)).dropDuplicates(), fk, "left_anti")
    return rows


def cascade_delete(tables: Tables, parent: str, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove ``keys`` of ``parent`` and every dependent row.

    Returns (remaining rows per affected table, counts of removed rows per table).  A table's
    remaining rows are those whose foreign keys name no deleted parent; asking for one table's
    rows computes no other's.
    """
    pk = PRIMARY_KEYS[parent]
    doomed = doomed_rows(tables, parent, keys)
    remaining = {parent: tables[parent].join(keys.select(*pk).dropDuplicates(), pk, "left_anti")}
    for child, links in _dependents(tables, parent).items():
        remaining[child] = _without(tables[child], doomed, links)
    counts = [d.agg(F.count(F.lit(1)).cast("bigint").alias("removed")).select(F.lit(t).alias("table_name"), "removed")
              for t, d in doomed.items()]
    return remaining, functools.reduce(lambda a, b: a.unionByName(b), counts)


# -- R7 ----------------------------------------------------------------------
_VIOLATION = "table_name STRING, constraint_name STRING, kind STRING, key_value STRING, n BIGINT"


def constraint_checks(columns: Mapping[str, Sequence[str]]) -> list[tuple]:
    """The checks that apply to tables with the given columns.

    ("DUPLICATE_KEY"|"DUPLICATE_UNIQUE", table, key columns) |
    ("ORPHAN", table, fk column, parent table, parent key) |
    ("NOT_ALLOWED", table, column, allowed values)
    """
    checks: list[tuple] = []
    for t, cols in columns.items():
        have = set(cols)
        if t not in PRIMARY_KEYS:
            continue
        for kind, keysets in (("DUPLICATE_KEY", [PRIMARY_KEYS[t]]), ("DUPLICATE_UNIQUE", UNIQUE_KEYS.get(t, []))):
            for ks in keysets:
                if all(k in have for k in ks):
                    checks.append((kind, t, tuple(ks)))
        for fk, ptable, pkey, _ in FOREIGN_KEYS.get(t, []):
            if fk in have and ptable in columns and pkey in set(columns[ptable]):
                checks.append(("ORPHAN", t, fk, ptable, pkey))
        for (et, col), values in ENUMS.items():
            if et == t and col in have:
                checks.append(("NOT_ALLOWED", t, col, tuple(values)))
    return checks


def _constraint_rows(df: DataFrame, checks: list[tuple[int, int, tuple]], folded: dict[tuple[int, int], str]) -> DataFrame:
    """(domain, slot, number or text of the key) for every row of ``df`` and check that it takes part in.

    A domain is a key's set of values: that of a primary key also takes the foreign keys that refer to it.  A check is known by
    its domain and its slot there.  Values outside an allowed list are rows, allowed ones are not.  ``folded``: checks whose
    text keys are equal under a collation.
    """
    kinds, entries = dict(df.dtypes), []
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    collation = next(iter(folded.values()), None)
    for domain, slot, c in checks:
        names = [c[2]] if isinstance(c[2], str) else list(c[2])
        cols = [F.col(n) for n in names]
        wanted = functools.reduce(lambda x, y: x & y, [x.isNotNull() for x in cols])
        number, text = no_number, no_text
        if c[0] == "NOT_ALLOWED":
            wanted, text = ~cols[0].isin(list(c[3])), cols[0].cast("string")
        elif len(names) == 1 and kinds[names[0]] in ("bigint", "int", "smallint", "tinyint"):
            number = cols[0].cast("bigint")
        else:  # several columns: a text that keeps them apart, whatever they hold
            text = cols[0].cast("string") if len(names) == 1 else F.to_json(F.array(*[x.cast("string") for x in cols]))
        fields = [F.lit(domain).alias("domain"), F.lit(slot).alias("slot"), number.alias("number"), text.alias("text")]
        if collation is not None:
            fields.append(F.collate(text if (domain, slot) in folded else no_text, collation).alias("folded"))
        entries.append(F.when(wanted, F.struct(*fields)))
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def constraint_violations(tables: Tables, columns: Mapping[str, Sequence[str]] | None = None,
                          collation: str | None = None) -> DataFrame:
    """Duplicate keys, orphan foreign keys and values outside the allowed lists.

    Every table is read once: each row gives its keys, its foreign keys and its values outside a list.  One aggregation over
    all of them counts, per value of a domain, the rows of each check (a hot foreign key is combined map-side): a value
    whose primary key counts nothing is an orphan of the checks that count it.  Nothing is joined but the names of
    the checks.  Numbers stay numbers throughout, and only what violates a rule is turned into text.

    NULL keys are never duplicates or orphans (as in SQL), NULL values are not checked
    against lists.  ``columns`` limits the checks to those columns.  With a ``collation`` (e.g.
    ``CI_AI``) text keys that it calls equal are duplicates, reported under the smallest of them.
    """
    cols = columns or {t: df.columns for t, df in tables.items()}
    checks = constraint_checks({t: c for t, c in cols.items() if t in tables})
    if not checks:
        return SparkSession.getActiveSession().createDataFrame([], _VIOLATION)
    domains: dict[str, int] = {}
    number = lambda name: domains.setdefault(name, len(domains))
    by_table: dict[str, list[tuple[int, int, tuple]]] = {}
    lines, taken, folded = [], {}, {}
    for c in checks:
        kind, t = c[0], c[1]
        if kind == "ORPHAN":
            domain, name = number(f"{c[3]}.{c[4]}"), f"{c[2]}->{c[3]}.{c[4]}"
        elif kind == "NOT_ALLOWED":
            domain, name = number(f"{t}.{c[2]} allowed"), c[2]
        else:
            domain, name = number(f"{t}.{','.join(c[2])}"), "(" + ",".join(c[2]) + ")"
        slot = 0 if kind == "DUPLICATE_KEY" else taken.get(domain, 0) + 1  # slot 0 is the primary key's
        taken[domain] = max(slot, taken.get(domain, 0))
        if collation is not None and kind == "DUPLICATE_UNIQUE":
            folded[domain, slot] = collation
        by_table.setdefault(t, []).append((domain, slot, c))
        lines.append((domain, slot, t, name, kind, len(c[2]) > 1 and not isinstance(c[2], str)))
    spark = next(iter(tables[t] for t in by_table)).sparkSession
    named = spark.createDataFrame(lines, "domain INT, slot INT, table_name STRING, constraint_name STRING, kind STRING, several BOOLEAN")  # one row per check
    rows = functools.reduce(lambda a, b: a.unionByName(b), [_constraint_rows(tables[t], cs, folded) for t, cs in by_table.items()])
    slots = range(max(taken.values()) + 1)
    counts = [F.count(F.when(F.col("slot") == i, 1)).alias(f"n{i}") for i in slots]
    if folded:
        whole = F.when(F.col("folded").isNull(), F.col("text"))
        counted = rows.groupBy("domain", "number", whole.alias("whole"), "folded").agg(F.min("text").alias("text"), *counts)
    else:
        counted = rows.groupBy("domain", "number", "text").agg(*counts)
    per_check = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"n{i}").alias("n")) for i in slots])).alias("e")
    # a value that its primary key holds once violates nothing
    found = counted.where("n0 <> 1").select("domain", "number", "text", (F.col("n0") > 0).alias("held"), per_check)
    found = found.select("domain", "number", "text", "held", "e.slot", "e.n").where("n > 0")
    wrong = F.when(F.col("kind") == "ORPHAN", ~F.col("held")).when(F.col("kind") == "NOT_ALLOWED", True).otherwise(F.col("n") > 1)
    shown = F.when(F.col("several"), F.concat_ws(",", F.from_json("text", "array<string>"))).otherwise(
        F.coalesce(F.col("number").cast("string"), "text"))
    return (found.join(F.broadcast(named), ["domain", "slot"]).where(wrong)
            .select("table_name", "constraint_name", "kind", shown.alias("key_value"), "n"))
