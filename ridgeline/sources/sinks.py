"""Writers: statements as CSV text lines, cohorts replaced partition by partition, sheets with live formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.text import csv_cell
from ridgeline.operators.solver import Equation


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The cells of each row as one line; written by `write_csv` with a byte order mark and CRLF."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`").cast("string")) for c in columns]).alias("line"))


def replace_cohorts(rows: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions (cohorts) that rows holds are rewritten; a repeated write gives the same table."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV files with a byte order mark before the header, CRLF line ends, quotes doubled and null as an empty cell."""
    named = [F.col(f"`{c}`").alias("\ufeff" + c if k == 0 else c) for k, c in enumerate(columns)]
    out = rows.select(*named).write.mode("overwrite").option("header", True).option("lineSep", "\r\n")
    out.option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def column_letters(number: int) -> str:
    """A sheet's column (from 1) as letters: Z is 26, AA is 27."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def formula_grid(wide: DataFrame, keys: list[str], columns: list[str], row: str) -> DataFrame:
    """A sheet's rows: the cells and a live sum over them; `row` holds the row's number on the sheet."""
    first, last = (column_letters(len(keys) + k) for k in (1, len(columns)))
    total = F.concat(F.lit(f"=SUM({first}"), F.col(row).cast("string"), F.lit(f":{last}"), F.col(row).cast("string"), F.lit(")"))
    return wide.select(*keys, *columns, total.alias("total"))


def sum_formula(row: Column, columns: list[int]) -> Column:
    """A live sum of a row's cells that shows nothing while none of them is filled."""
    cells = F.concat_ws(",", *[F.concat(F.lit(column_letters(c)), row.cast("string")) for c in columns])
    return F.concat(F.lit("=IF(COUNT("), cells, F.lit(')=0,"",SUM('), cells, F.lit("))"))


def equation_formula(equation: Equation, metric: str, row_of: Column, column: Column) -> Column:
    """A metric's cell from its equation's other operands in the same column (letters): row_of maps metrics to their rows.

    It shows nothing while an operand is empty or a divisor is 0, and is null where an operand has no row on the sheet.
    """
    cell = {m: F.concat(column, F.element_at(row_of, F.lit(m)).cast("string")) for m in equation.operands if m != metric}
    blank = F.concat(F.lit("OR("), F.concat_ws(",", *[F.concat(c, F.lit('=""')) for c in cell.values()]))
    if equation.kind == "ratio":
        over, under = (cell[m] for m in equation.parts)  # a ratio's own cell: its operands are typed in
        told = F.concat(F.lit("=IF("), blank, F.lit(","), under, F.lit('=0),"",'), over, F.lit("/"), under, F.lit(")"))
    else:
        rest = lambda xs: tuple(x for x in xs if x != metric)
        if metric in equation.minus:  # total = parts - minus, so it is parts less the total and the other minus
            added, taken = equation.parts, (equation.total, *rest(equation.minus))
        elif metric == equation.total:
            added, taken = equation.parts, equation.minus
        else:
            added, taken = (equation.total, *equation.minus), rest(equation.parts)
        text = F.concat(F.concat_ws("+", *[cell[m] for m in added]), *[F.concat(F.lit("-"), cell[m]) for m in taken])
        told = F.concat(F.lit("=IF("), blank, F.lit('),"",'), text, F.lit(")"))
    return F.when(F.forall(F.array(*[F.element_at(row_of, F.lit(m)) for m in cell]), lambda r: r.isNotNull()), told)
