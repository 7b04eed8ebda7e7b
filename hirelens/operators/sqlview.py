"""S3: filters, search, counts and distinct values as SQL over a temporary view, values bound as parameters.

The text holds only the view, quoted identifiers of columns the table has, and parameter
names; what a user chose or typed reaches Spark through ``spark.sql(text, args=...)`` and is
never part of the text.  The forms give the rows of their DataFrame counterparts in ``filters``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

LITERAL = "\\u0001"  # escape character of LIKE that no typed text holds: % and _ stay wildcards, a backslash is itself


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class TableView:
    """A table under a view name of its own; each form returns a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df, self.columns = df, df.columns

    def where(self, filters: dict[str, list] | None = None, search_text: str | None = None,
              search_cols: list[str] | None = None) -> tuple[str, dict]:
        """The WHERE text and its arguments; unknown columns and empty lists are left out."""
        clauses, args = [], {}
        for column, values in (filters or {}).items():
            if column in self.columns and values:
                names = [f"f{len(args) + k}" for k in range(len(values))]
                args.update(zip(names, values))
                clauses.append(f"{quoted(column)} IN ({', '.join(':' + n for n in names)})")
        looked = [c for c in search_cols or [] if c in self.columns]
        if search_text and looked:
            args["search"] = f"%{search_text.strip().lower()}%"
            clauses.append("(" + " OR ".join(f"lower(CAST({quoted(c)} AS STRING)) LIKE :search ESCAPE '{LITERAL}'" for c in looked) + ")")
        return (" WHERE " + " AND ".join(clauses) if clauses else ""), args

    def run(self, select: str, rest: str = "", args: dict | None = None) -> DataFrame:
        spark, view = self.df.sparkSession, f"table_view_{uuid.uuid4().hex}"
        self.df.createTempView(view)
        try:
            return spark.sql(f"SELECT {select} FROM {view}{rest}", args=args or {})
        finally:
            spark.catalog.dropTempView(view)  # the result is resolved and keeps its own plan

    def filtered(self, filters: dict[str, list] | None = None, search_text: str | None = None, search_cols: list[str] | None = None,
                 columns: list[str] | None = None, limit: int | None = None, order_by: str | None = None) -> DataFrame:
        """the chosen columns (those the table has; none: all) of matching rows, ordered, at most ``limit``."""
        where, args = self.where(filters, search_text, search_cols)
        chosen = ", ".join(quoted(c) for c in columns or [] if c in self.columns) or "*"
        if order_by in self.columns:
            where += f" ORDER BY {quoted(order_by)} NULLS LAST"
        if limit:
            where, args = where + " LIMIT :most", {**args, "most": int(limit)}
        return self.run(chosen, where, args)

    def count(self, filters: dict[str, list] | None = None, search_text: str | None = None, search_cols: list[str] | None = None) -> DataFrame:
        """F4."""
        return self.run("count(*) AS row_count", *self.where(filters, search_text, search_cols))

    def group_count(self, column: str, filters: dict[str, list] | None = None) -> DataFrame:
        """Rows per value, the most frequent first; an unknown column gives an empty result."""
        if column not in self.columns:
            return self.df.sparkSession.createDataFrame([], "group_key string, count long")
        where, args = self.where(filters)
        return self.run(f"{quoted(column)} AS group_key, count(*) AS count", f"{where} GROUP BY {quoted(column)} ORDER BY count DESC", args)

    def distinct_values(self, column: str, limit: int = 500) -> DataFrame:
        """the first ``limit`` distinct values in order, then trimmed and without blanks."""
        if column not in self.columns:
            return self.df.sparkSession.createDataFrame([], "value string")
        first = self.run(f"DISTINCT {quoted(column)} AS v", f" WHERE {quoted(column)} IS NOT NULL ORDER BY v LIMIT :most", {"most": int(limit)})
        return first.selectExpr(r"regexp_replace(CAST(v AS STRING), r'^\s+|\s+$', '') AS value").where("value <> ''")
