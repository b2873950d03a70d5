"""python -m bytetree COMMAND FILE [EXPR] [--schema FILE --type NAME]: print, dump (json, yaml, python or raw), list, xdump.

The schema is that of the file's format unless one is given; EXPR is read in the whole file's structure.

python -m bytetree shell [SCRIPT]: a session of verbs, one a line (see `Shell`).
"""

from __future__ import annotations

import argparse
import cmd
import json
import logging
import pprint
import shlex
import sys

from .decode.board import Board
from .decode.box import Box
from .errors import PathError
from .formats import find_format, schema_of
from .plans.typing import plain


class Shell(cmd.Cmd):
    """import NAME FILE | import NAME spec FILE | use FILE | clear [NAME] | let NAME = EXPR | unset NAME | bind NAME SPEC.TYPE FILE |
    list [EXPR] | print EXPR | dump EXPR | set loglevel LEVEL | quit"""

    prompt = "bytetree> "
    log = logging.getLogger("bytetree")

    def __init__(self, **how):
        super().__init__(**how)
        self.board = Board()

    def onecmd(self, line: str) -> bool:
        self.log.debug("%s", line)
        try:
            return bool(super().onecmd(line))
        except (PathError, OSError, ValueError) as e:
            self.log.info("%s", e, exc_info=True)
            self.say(f"{type(e).__name__}: {e}")
            return False

    def default(self, line: str) -> None:
        if line.strip() and not line.startswith("#"):
            self.do_print(line)

    def emptyline(self) -> None:
        pass

    def say(self, text) -> None:
        self.stdout.write(f"{text}\n")

    def do_import(self, rest: str) -> None:
        """import NAME FILE: data; import NAME spec FILE: a schema."""
        name, *more = shlex.split(rest)
        with open(more[-1], "rb") as f:
            if len(more) == 2 and more[0] == "spec":
                self.board.add_spec(name, f.read().decode())
            elif len(more) == 1:
                self.board.add_data_source(name, f.read())
            else:
                raise ValueError(self.do_import.__doc__)

    def do_use(self, rest: str) -> None:
        """use FILE: the schema's names without a prefix; without a file, none any more."""
        self.board.forget_spec()
        if rest.strip():
            with open(rest.strip(), encoding="utf-8") as f:
                self.board.use_spec(f.read())

    def do_clear(self, rest: str) -> None:
        """clear: forget all names; clear NAME: forget one."""
        if rest.strip():
            self.board.remove(rest.strip())
        else:
            self.board = Board()

    def do_let(self, rest: str) -> None:
        """let NAME = EXPR: a name for an expression, read anew whenever it is used."""
        name, _, expr = rest.partition("=")
        if not expr.strip():
            raise ValueError(self.do_let.__doc__)
        self.board.add_expr(name.strip(), expr.strip().rstrip(";"))

    def do_unset(self, rest: str) -> None:
        """unset NAME"""
        self.board.remove(rest.strip())

    def do_bind(self, rest: str) -> None:
        """bind NAME TYPE FILE: NAME stands for the file's data read as TYPE."""
        name, kind, path = shlex.split(rest)
        with open(path, "rb") as f:
            self.board.add_data_source(f"{name}_data", f.read())
        self.board.add_expr(name, f"{name}_data <> {kind}")

    def do_list(self, rest: str) -> None:
        """list: all names; list EXPR: the members or the number of items there."""
        if not rest.strip():
            self.say("\n".join(self.board.names()))
            return
        v = self.board.eval(rest)
        inner = isinstance(v, Box) and v.stage.block and v.stage.kind in ("struct", "union")
        self.say("\n".join(f.name for f in v.fields() if f.name) if inner else v.length())

    def do_print(self, rest: str) -> None:
        self.say(pprint.pformat(self.board.read(rest)))

    def do_dump(self, rest: str) -> None:
        self.say(json.dumps(plain(self.board.read(rest)), indent=4))

    def do_set(self, rest: str) -> None:
        """set loglevel debug|info|warning|error"""
        what, level = rest.split()
        if what != "loglevel" or level.upper() not in logging.getLevelNamesMapping():
            raise ValueError(self.do_set.__doc__)
        logging.basicConfig(stream=sys.stderr)
        self.log.setLevel(level.upper())

    def do_quit(self, rest: str) -> bool:
        return True

    do_EOF = do_quit


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["shell"]:
        shell = Shell()
        if argv[1:]:
            with open(argv[1], encoding="utf-8") as f:
                for line in f:
                    if shell.onecmd(line.rstrip("\n")):
                        break
        else:
            shell.cmdloop()
        return 0
    p = argparse.ArgumentParser(prog="bytetree", description=__doc__)
    p.add_argument("command", choices=("print", "dump", "list", "xdump"))
    p.add_argument("file")
    p.add_argument("expr", nargs="?", default="self")
    p.add_argument("--schema")
    p.add_argument("--type", default="File")
    p.add_argument("--as", dest="form", choices=("json", "yaml", "python", "raw"), default="json")
    a = p.parse_args(argv)
    board = Board()
    with open(a.file, "rb") as f:
        board.add_data_source("data", f.read())
    if a.schema:
        with open(a.schema, encoding="utf-8") as f:
            text, top = f.read(), a.type
    else:
        name = find_format(a.file)
        if name is None:
            p.error("no known format; give --schema")
        text, top = schema_of(name)
    board.add_spec("Spec", text)
    v = board.eval(a.expr, board.eval(f"data <> Spec.{top}"))
    if a.command == "list":
        print("\n".join(f.name for f in v.fields() if f.name) if v.stage.block and v.stage.kind in ("struct", "union") else v.length())
    elif a.command == "xdump" or a.form == "raw" and a.command == "dump":
        src, start, stop = v.output()
        if a.form == "raw" and a.command == "dump":
            sys.stdout.buffer.write(src.data[start:stop])
            return 0
        for at in range(start, stop, 16):
            row = src.data[at : min(at + 16, stop)]
            print(f"{at:012x}  {row.hex(' '):<47}  {''.join(chr(c) if 32 <= c < 127 else '.' for c in row)}")
    else:
        value = v.deep() if isinstance(v, Box) else v
        if a.command == "print" or a.form == "python":
            pprint.pprint(value)
        elif a.form == "yaml":
            import yaml

            print(yaml.safe_dump(plain(value), default_flow_style=False))
        else:
            print(json.dumps(plain(value), indent=4))
    return 0


if __name__ == "__main__":
    sys.exit(main())
