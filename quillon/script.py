"""Line-based pipeline scripts.

Each line is a command on the focused frame; a leading dot is optional, ``#``
starts a comment outside quotes, a trailing backslash continues a line.
Commands build a lazy plan; only those that print, write or collect run it.
"""

from __future__ import annotations

import difflib
import os
import shlex
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from quillon import introspect
from quillon.expr import col
from quillon.frame import Frame
from quillon.plans.parse import parse, parse_predicate
from quillon.sources import files
from quillon.transpile import transpile  # noqa: F401


class ScriptError(Exception):
    pass


class Quit(Exception):
    pass


@dataclass(frozen=True)
class Command:
    name: str
    signature: str
    summary: str
    run: Callable[[Interpreter, str], None]


COMMANDS: dict[str, Command] = {}


def command(signature: str, summary: str, *aliases: str) -> Callable:
    def add(f: Callable[[Interpreter, str], None]) -> Callable:
        name = signature.split()[0]
        for n in (name, *aliases):
            COMMANDS[n] = Command(n, signature.replace(name, n, 1), summary, f)
        return f

    return add


def strip_comment(line: str) -> str:
    """Drop what follows the first ``#`` outside double quotes that isn't escaped."""
    quoted = False
    i = 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "#" and not quoted:
            return line[:i]
        i += 1
    return line


def statements(text: str) -> list[tuple[int, str]]:
    """(line number, statement) with continuations joined."""
    out, held, start = [], "", 0
    for n, raw in enumerate(text.splitlines(), 1):
        line = strip_comment(raw).rstrip()
        start = start or n
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        whole = (held + line).strip()
        if whole:
            out.append((start, whole[1:].lstrip() if whole.startswith(".") else whole))
        held, start = "", 0
    if held.strip():
        out.append((start, held.strip().lstrip(".")))
    return out


class Interpreter:
    """Runs statements; printed text goes to ``self.out``."""

    def __init__(self, spark: SparkSession, write: Callable[[str], Any] | None = None):
        self.spark = spark
        self.out: list[str] = []
        self.write = write or self.out.append
        self.frames: dict[str, Frame] = {}
        self.source: Frame | None = None
        self.focus: Frame | None = None
        self.timing = False
        self.began = time.time()
        self.folder = os.getcwd()

    # --- helpers of commands

    @property
    def frame(self) -> Frame:
        if self.focus is None:
            raise ScriptError("no frame is loaded")
        return self.focus

    def path(self, name: str) -> str:
        return name if "://" in name else os.path.normpath(os.path.join(self.folder, os.path.expanduser(name)))

    def table(self, f: Frame, n: int | None = None) -> None:
        rows = (f if n is None else f.head(n)).collect()
        cells = [[str(c) for c in f.columns], *[["null" if v is None else str(v) for v in r] for r in rows]]
        widths = [max(len(r[i]) for r in cells) for i in range(len(f.columns))]
        self.write("\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells))

    # --- running

    def run_line(self, statement: str) -> None:
        word, _, rest = statement.strip().lstrip(".").partition(" ")
        if word not in COMMANDS:
            near = difflib.get_close_matches(word, COMMANDS, 1)
            raise ScriptError(f"unknown command {word}" + (f" (did you mean {near[0]}?)" if near else ""))
        began = time.perf_counter()
        COMMANDS[word].run(self, rest.strip())
        if self.timing:
            self.write(f"{word}: {(time.perf_counter() - began) * 1000:.1f} ms")

    def run(self, text: str, name: str = "script") -> Frame | None:
        for n, s in statements(text):
            try:
                self.run_line(s)
            except Quit:
                break
            except ScriptError as e:
                raise ScriptError(f"{name}:{n}: {e}") from e
            except Exception as e:
                raise ScriptError(f"{name}:{n}: {s.split()[0]}: {e}") from e
        return self.focus

    def run_file(self, path: str) -> Frame | None:
        with open(self.path(path), encoding="utf-8") as f:
            return self.run(f.read(), path)


def _words(rest: str, least: int = 0) -> list[str]:
    got = shlex.split(rest)
    if len(got) < least:
        raise ScriptError("an argument is missing")
    return got


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace(" ", ",").split(",") if x.strip()]


def _value(text: str) -> Any:
    e = parse(text)
    return e.params[0] if e.op == "lit" else text


def _number(text: str, default: int) -> int:
    try:
        return int(text) if text else default
    except ValueError as e:
        raise ScriptError(f"{text!r} is no whole number") from e


# --- frames and files


def _load(s: Interpreter, rest: str, reader: Callable | None = None) -> None:
    w = _words(rest, 1)
    f = (reader or files.scan)(s.spark, s.path(w[0]))
    if len(w) >= 3 and w[1] == "as":
        s.frames[w[2]] = f
    else:
        s.source = s.focus = f


command("load <path> [as NAME]", "Load a file as the focused frame, or under a name.")(_load)
for _name, _reader in {"scan_csv": files.read_csv, "scan_parquet": files.read_parquet, "scan_ipc": files.read_ipc, "scan_ndjson": files.read_ndjson, "scan_json": files.read_json, "scan_auto": None}.items():
    command(f"{_name} <path> [as NAME]", "Lazy scan of a file.")(lambda s, rest, r=_reader: _load(s, rest, r))


@command("use <NAME>", "Focus a named frame.")
def _use(s, rest):
    if rest not in s.frames:
        raise ScriptError(f"no frame {rest}")
    s.source = s.focus = s.frames[rest]


@command("stash <NAME>", "Keep the focused frame under a name.")
def _stash(s, rest):
    s.frames[_words(rest, 1)[0]] = s.focus = s.frame.cache()


@command("frames", "List named frames.")
def _frames(s, rest): s.write("\n".join(f"{n}: {', '.join(f.columns)}" for n, f in sorted(s.frames.items())))


@command("drop_frame <NAME>", "Forget a named frame.")
def _drop_frame(s, rest):
    if rest not in s.frames:
        raise ScriptError(f"no frame {rest}")
    s.frames.pop(rest).df.unpersist()


@command("save <path>", "Write the focused frame.", "write")
def _save(s, rest): files.save(s.frame, s.path(_words(rest, 1)[0]))
@command("collect", "Run the pipeline and keep its result as the source.")
def _collect(s, rest): s.source = s.focus = s.frame.materialise()
@command("reset", "Drop the pipeline, keep the source.")
def _reset(s, rest): s.focus = s.source
@command("source <path>", "Run another script here.")
def _source(s, rest): s.run_file(_words(rest, 1)[0])

# --- looking


@command("show", "Print the first rows.", "head", "ishow", "browse")
def _show(s, rest): s.table(s.frame, _number(rest, 10))
@command("tail [N]", "Print the last rows.")
def _tail(s, rest): s.table(s.frame.tail(_number(rest, 10)))
@command("schema", "Print columns and types.")
def _schema(s, rest): s.write("\n".join(f"{n}: {t}" for n, t in s.frame.dtypes))
@command("describe", "Statistics per column.")
def _describe(s, rest): s.table(s.frame.describe())
@command("glimpse [N]", "First values of each column.")
def _glimpse(s, rest): s.write(s.frame.glimpse(_number(rest, 5)))
@command("size", "Arrow bytes of the frame.")
def _size(s, rest): s.write(f"{s.frame.estimated_size()} bytes")
@command("null_count", "Nulls per column.", "null_count_all")
def _null_count(s, rest): s.table(s.frame.null_count())
@command("explain", "Logical and physical plan.")
def _explain(s, rest): s.write(introspect.explain(s.frame))
@command("explain_tree", "Plan as a tree.", "tree")
def _tree(s, rest): s.write(introspect.explain_tree(s.frame))
@command("graph", "Plan as a Graphviz graph.", "show_graph")
def _graph(s, rest): s.write(introspect.graph(s.frame))
@command("mermaid", "Plan as a Mermaid flowchart.")
def _mermaid(s, rest): s.write(introspect.mermaid(s.frame))


for _op in ("sum", "mean", "min", "max", "median", "std", "skew", "kurtosis", "approx_n_unique"):
    @command(f"{_op} <col>", f"Print the {_op} of a column.")
    def _stat(s, rest, op=_op): s.write(str(s.frame.select(getattr(col(_words(rest, 1)[0]), op)()).collect()[0][0]))
for _op in ("sum", "mean", "min", "max", "std", "var", "median", "count"):
    @command(f"{_op}_all", f"The {_op} of every column, one row.")
    def _all(s, rest, op=_op): s.focus = s.frame.agg_all(op)


@command("corr <a> <b>", "Pearson correlation of two columns.")
def _corr(s, rest): s.write(str(s.frame.pearson_corr(*_words(rest, 2)[:2])))
@command("cov <a> <b>", "Sample covariance of two columns.")
def _cov(s, rest): s.write(str(s.frame.covariance(*_words(rest, 2)[:2])))

# --- pipeline


@command("select <col>[,<col>...]", "Keep columns.")
def _select(s, rest): s.focus = s.frame.select(*_list(rest))
@command("drop <col>[,<col>...]", "Drop columns.")
def _drop(s, rest): s.focus = s.frame.drop(*_list(rest))
@command("filter <predicate>", "Keep rows.")
def _filter(s, rest): s.focus = s.frame.filter(parse_predicate(rest))
@command("limit <N>", "Keep the first rows.")
def _limit(s, rest): s.focus = s.frame.head(_number(rest, 10))
@command("reverse", "Reverse the row order.")
def _reverse(s, rest): s.focus = s.frame.reverse()
@command("unique", "Drop repeated rows.")
def _unique(s, rest): s.focus = s.frame.unique()
@command("explode <col>", "List elements as rows.")
def _explode(s, rest): s.focus = s.frame.explode(rest)
@command("unnest <col>", "Struct fields as columns.")
def _unnest(s, rest): s.focus = s.frame.unnest(rest)
@command("forward_fill [limit]", "Fill nulls forward.")
def _ffill(s, rest): s.focus = s.frame.forward_fill(_number(rest, 0))
@command("backward_fill [limit]", "Fill nulls backward.")
def _bfill(s, rest): s.focus = s.frame.backward_fill(_number(rest, 0))
@command("fill_null <value>", "Replace nulls in fitting columns.")
def _fill_null(s, rest): s.focus = s.frame.fill_null(_value(rest))
@command("fill_nan <value>", "Replace NaN in float columns.")
def _fill_nan(s, rest): s.focus = s.frame.fill_nan(float(rest))
@command("drop_null [col...]", "Drop rows with nulls.")
def _drop_null(s, rest): s.focus = s.frame.drop_nulls(*_list(rest))


@command("sort <col> [asc|desc]", "Sort by a column.")
def _sort(s, rest):
    w = _words(rest, 1)
    s.focus = s.frame.sort(w[0], len(w) > 1 and w[1].lower() == "desc")


@command("sample <N> [seed]", "Draw rows.")
def _sample(s, rest):
    w = _words(rest, 1)
    s.focus = s.frame.sample(int(w[0]), seed=int(w[1]) if len(w) > 1 else 0)


@command("shuffle [seed]", "Permute the rows.")
def _shuffle(s, rest): s.focus = s.frame.shuffle(_number(rest, 0))


@command("cast <col> <dtype>", "Change a column's type.")
def _cast(s, rest): s.focus = s.frame.cast(*_words(rest, 2)[:2])


@command("rename <old> as <new>", "Rename a column.")
def _rename(s, rest):
    w = [x for x in _words(rest, 2) if x != "as"]
    s.focus = s.frame.rename(w[0], w[1])


@command("with_row_index <name> [offset]", "Prepend a row number.")
def _row_index(s, rest):
    w = _words(rest, 1)
    s.focus = s.frame.with_row_index(w[0], int(w[1]) if len(w) > 1 else 0)


@command("with <name> = <expression>", "Add a column computed by an expression.")
def _with(s, rest):
    name, eq, text = rest.partition("=")
    if not eq or not name.strip():
        raise ScriptError("expected <name> = <expression>")
    s.focus = s.frame.with_columns(parse(text).alias(name.strip()))


@command("groupby <k1,k2,...> <col:op[:alias]>...", "Group and aggregate.")
def _groupby(s, rest):
    w = _words(rest, 1)
    aggs = []
    for spec in w[1:]:
        parts = spec.split(":")
        if len(parts) < 2:
            raise ScriptError(f"{spec} is no col:op")
        aggs.append(getattr(col(parts[0]), {"avg": "mean"}.get(parts[1], parts[1]))().alias(parts[2] if len(parts) > 2 else f"{parts[0]}_{parts[1]}"))
    s.focus = s.frame.group_by(*w[0].split(",")).agg(*aggs)


@command("join <path|NAME> on <key> [inner|left|cross]", "Join with a file or named frame.")
def _join(s, rest):
    w = _words(rest, 1)
    other = s.frames.get(w[0]) or files.scan(s.spark, s.path(w[0]))
    how = w[3] if len(w) > 3 else "inner"
    s.focus = s.frame.join(other, [] if how == "cross" else w[2].split(","), how)


@command("top_k <K> <col>", "Rows with the largest values.")
def _top_k(s, rest): s.focus = s.frame.top_k(int(_words(rest, 2)[0]), _words(rest)[1])
@command("bottom_k <K> <col>", "Rows with the smallest values.")
def _bottom_k(s, rest): s.focus = s.frame.bottom_k(int(_words(rest, 2)[0]), _words(rest)[1])
@command("transpose [header] [prefix]", "Columns as rows.")
def _transpose(s, rest): s.focus = s.frame.transpose(*_words(rest))


@command("unpivot <ids> [values]", "Wide to long.")
def _unpivot(s, rest):
    w = _words(rest, 1)
    s.focus = s.frame.unpivot(w[0].split(","), w[1].split(",") if len(w) > 1 else None)


@command("pivot <index> <on> <values> [agg]", "Long to wide.")
def _pivot(s, rest):
    w = _words(rest, 3)
    s.focus = s.frame.pivot(w[0].split(","), w[1], w[2], w[3] if len(w) > 3 else "first")


@command("partition_by <keys>", "One frame per key combination; prints them.")
def _partition(s, rest):
    keys = _list(rest)
    s.table(s.frame.group_by(*keys).agg(col(keys[0]).count().alias("rows")))


@command("upsample <col> <every>", "Regular time grid.")
def _upsample(s, rest): s.focus = s.frame.upsample(*_words(rest, 2)[:2])


for _op in ("sum", "mean", "min", "max", "all", "any"):
    @command(f"{_op}_horizontal <out> [col...]", f"Row-wise {_op} as a column.")
    def _horizontal(s, rest, op=_op):
        w = _words(rest, 1)
        s.focus = getattr(s.frame, f"{op}_horizontal")(*w)

# --- session


@command("timing", "Switch timing of statements.")
def _timing(s, rest): s.timing = not s.timing
@command("info", "Versions and uptime.")
def _info(s, rest): s.write(f"Spark {s.spark.version}, {s.spark.sparkContext.master}, up {time.time() - s.began:.0f} s")
@command("clear", "Wipe the terminal.")
def _clear(s, rest): s.write("\x1b[2J\x1b[H")
@command("help", "List commands.")
def _help(s, rest): s.write("\n".join(f"{c.signature:<44}{c.summary}" for c in COMMANDS.values()))
@command("pwd", "Print the folder.")
def _pwd(s, rest): s.write(s.folder)
@command("ls [path]", "List files.")
def _ls(s, rest): s.write("\n".join(sorted(os.listdir(s.path(rest or ".")))))


@command("cd [path]", "Change the folder.")
def _cd(s, rest):
    folder = s.path(rest or "~")
    if not os.path.isdir(folder):
        raise ScriptError(f"no folder {folder}")
    s.folder = folder


@command("exit", "End.", "quit")
def _exit(s, rest):
    raise Quit


def prompt_loop(s: Interpreter, read: Callable[[str], str] = input) -> None:
    """Read statements until the end of input or ``exit``; errors are printed and the loop goes on."""
    held = ""
    while True:
        try:
            line = strip_comment(read("... " if held else "> ")).rstrip()
        except EOFError:
            return
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        for _, statement in statements(held + line):
            try:
                s.run_line(statement)
            except Quit:
                return
            except Exception as e:  # noqa: BLE001
                s.write(f"error: {e}")
        held = ""
