"""SQL scripts: files of Spark SQL that read other files and call Python.

A line ``.read FILE`` runs another script in its place, and ``.python FILE`` runs Python
with ``spark`` and ``var``.  A file is looked for beside the script that names it, then
in the include folders.  Values given to a script are session variables, so statements
name them like columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DIRECTIVE = re.compile(r"\s*\.(\w+)\s+(.+?)\s*$")
SHOWN = 40
#: Text in which a semicolon ends nothing.
_QUIET = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)


class ScriptError(RuntimeError):
    pass


@dataclass(frozen=True)
class Step:
    """A statement (kind sql) or a Python file (kind python), and where it stands."""

    kind: str
    text: str
    file: Path
    line: int


def typed(text: str) -> object:
    """A value from a command line: a whole number, a float or a truth value only if it prints as it was written."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?(0|[1-9]\d*)", text) and text != "-0":
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text) and str(float(text)) == text:
        return float(text)
    return text


def statements(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement) of SQL text, parted by semicolons outside quotes and comments."""
    quiet = [m.span() for m in _QUIET.finditer(text)]
    cuts = [m.start() for m in re.finditer(";", text) if not any(a <= m.start() < b for a, b in quiet)]
    begin = 0
    for cut in [*cuts, len(text)]:
        body = text[begin:cut]
        if _QUIET.sub(lambda m: "" if m[0][:2] in ("--", "/*") else m[0], body).strip():
            yield text.count("\n", 0, begin + len(body) - len(body.lstrip())) + 1, body.strip()
        begin = cut + 1


def find(name: str, beside: Path, include: tuple[Path, ...]) -> Path:
    wanted = Path(name.strip("'\""))
    for folder in (beside, *include):
        if (path := folder / wanted).is_file():
            return path.resolve()
    raise ScriptError(f"no file {name} in {', '.join(map(str, (beside, *include)))}")


def steps(path: str | Path, include: tuple[str | Path, ...] = (), above: tuple[Path, ...] = ()) -> Iterator[Step]:
    """All steps of a script, those of the files it reads in their place."""
    path, folders = Path(path).resolve(), tuple(map(Path, include))
    if path in above:
        raise ScriptError(" reads ".join(map(str, (*above[above.index(path) :], path))))
    block, begin = [], 1

    def flushed() -> Iterator[Step]:
        for line, text in statements("\n".join(block)):
            yield Step("sql", text, path, begin + line - 1)

    for number, line in enumerate(path.read_text().splitlines(), 1):
        if not (m := DIRECTIVE.match(line)):
            block.append(line)
            continue
        yield from flushed()
        block, begin = [], number + 1
        if m[1] not in ("read", "python"):
            raise ScriptError(f"{path}, line {number}: no directive .{m[1]}")
        target = find(m[2], path.parent, folders)
        if m[1] == "read":
            yield from steps(target, include, (*above, path))
        else:
            yield Step("python", str(target), path, number)
    yield from flushed()


def expanded(path: str | Path, include: tuple[str | Path, ...] = ()) -> str:
    """The whole script as one text, as it will run."""
    return "\n".join(f"{s.text};" if s.kind == "sql" else f".python {s.text}" for s in steps(path, include))


def literal(value: object) -> str:
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_variables(spark: SparkSession, values: dict[str, object]) -> None:
    for name, value in values.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ScriptError(f"{name!r} isn't a variable's name")
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = {literal(typed(value) if isinstance(value, str) else value)}")


def run_python(spark: SparkSession, path: str | Path, **names: object) -> dict:
    """Runs a file with ``spark``, ``var`` (a session variable's value, or a default) and what else is given."""

    def var(name: str, default=None):
        try:
            value = spark.sql(f"SELECT {name} AS value").first()[0]
        except Exception:
            return default
        return default if value is None else value

    scope = {"__name__": "__main__", "__file__": str(path), "spark": spark, "var": var, **names}
    exec(compile(Path(path).read_text(), str(path), "exec"), scope)
    return scope


def shown(rows: DataFrame, most: int = SHOWN) -> str:
    """A small result as text."""
    found = rows.limit(most + 1).collect()
    table = [rows.columns, *(["" if v is None else str(v) for v in r] for r in found[:most])]
    wide = [max(map(len, column)) for column in zip(*table, strict=True)]
    lines = ["  ".join(v.ljust(n) for v, n in zip(row, wide, strict=True)).rstrip() for row in table]
    return "\n".join([*lines, *([f"({most} rows of more)"] if len(found) > most else [])])


def run_script(spark: SparkSession, path: str | Path, include: tuple[str | Path, ...] = (), show: Callable[[str], None] | None = None, **values: object) -> DataFrame | None:
    """Runs a script; gives the last statement's rows.  show: takes the text of each result that has rows."""
    set_variables(spark, values)
    last = None
    for step in list(steps(path, include)):
        try:
            if step.kind == "python":
                run_python(spark, step.text)
                continue
            last = spark.sql(step.text)
            if show and last.columns:
                show(shown(last))
        except ScriptError:
            raise
        except Exception as e:
            raise ScriptError(f"{step.file}, line {step.line}: {type(e).__name__}: {str(e).splitlines()[0]}\n{step.text}") from e
    return last
