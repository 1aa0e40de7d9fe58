"""Blocks that declare what they need and make, and plans that order them.

A plan holds the blocks that what is asked for rests on, and no others. Blocks are put into phases: window blocks over a symbol, one grouped
pass over a symbol for all values that depend on the one before them, window blocks over a date. A phase takes every block of its kind that is
ready, so rows change hands only where the kind of key changes, and once by symbol for a table of windows and recursions. Blocks over a date
that rest on the bars alone come first, so the many columns of a pass are not dealt by date; what is joined by date without a shuffle counts as a
window block and comes after them, for the same reason."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.windows import dealt
from ..operators import kernels as kn

WINDOW, PASS, DATE = "window", "pass", "date"


@dataclass(frozen=True)
class Block:
    """run: for a pass, from a pandas frame of one symbol's rows by date (with the needed columns) to the made columns as a list; else from table
    to table."""

    name: str
    run: Callable
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    kind: str = WINDOW


@dataclass
class Registry:
    """Blocks by name, and names for several of them (groups)."""

    blocks: dict[str, Block] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def add(self, name: str, run: Callable, needs: Iterable[str], makes: Iterable[str], kind: str = WINDOW) -> None:
        needs, makes = tuple(needs), tuple(makes)
        if name in self.blocks or name in self.groups:
            raise ValueError(f"{name} is taken")
        made = self.makers()
        if twice := [c for c in makes if c in made]:
            raise ValueError(f"{name} makes {twice[0]}, which {made[twice[0]].name} makes")
        if kind not in (WINDOW, PASS, DATE):
            raise ValueError(f"{kind} is no kind of block")
        self.blocks[name] = Block(name, run, needs, makes, kind)

    def group(self, name: str, members: Iterable[str]) -> None:
        if name in self.blocks or name in self.groups:
            raise ValueError(f"{name} is taken")
        self.groups[name] = tuple(members)

    def makers(self) -> dict[str, Block]:
        return {c: b for b in self.blocks.values() for c in b.makes}

    def named(self, wanted: Iterable[str]) -> list[str]:
        """Blocks of names of groups, blocks or columns, in order, each once."""
        makers, out = self.makers(), {}
        for name in wanted:
            if name in self.groups:
                out |= dict.fromkeys(self.named(self.groups[name]))
            elif name in self.blocks:
                out[name] = None
            elif name in makers:
                out[makers[name].name] = None
            else:
                raise ValueError(f"no block or column {name}")
        return list(out)

    def plan(self, wanted: Iterable[str], have: Iterable[str]) -> list[tuple[str, list[Block]]]:
        """Phases (kind, blocks in order) that make what is wanted from columns that are there. Blocks all of whose columns are there are done."""
        have, makers = set(have), self.makers()
        needed: dict[str, Block] = {}
        ask = self.named(wanted)
        while ask:
            block = self.blocks[ask.pop()]
            if block.name in needed or set(block.makes) <= have:
                continue
            needed[block.name] = block
            for column in block.needs:
                if column in have:
                    continue
                if column not in makers:
                    raise ValueError(f"{block.name} needs {column}, which nothing makes")
                ask.append(makers[column].name)
        left = [b for b in self.blocks.values() if b.name in needed]
        phases: list[tuple[str, list[Block]]] = []
        while left:
            ready = [b for b in left if set(b.needs) <= have]
            if not ready:
                raise ValueError("blocks need each other: " + ", ".join(b.name for b in left))
            # windows over a date change hands, so they come while rows are narrow; then as many windows as there are before a pass, whose output has to
            # be dealt anew for windows
            kind = next(k for k in (DATE, WINDOW, PASS) if any(b.kind == k for b in ready))
            phase: list[Block] = []
            while now := [b for b in left if b.kind == kind and set(b.needs) <= have]:
                phase += now
                left = [b for b in left if b not in now]
                have |= {c for b in now for c in b.makes}
            phases.append((kind, phase))
        return phases

    def run(self, table: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
        """table with the columns of what is wanted (all blocks by default), in the order of blocks; columns only needed on the way are dropped."""
        out, last, kept = self.before_pass(table, wanted)
        if last:
            out = kn.grouped(out, last)
        return out.select(*table.columns, *kept)

    def before_pass(self, table: DataFrame, wanted: Iterable[str] | None = None) -> tuple[DataFrame, list[tuple], list[str]]:
        """table after all phases but a pass that comes last, with no more columns than are asked for or needed there; that pass for kernels.grouped (empty where
        none comes last); and the asked columns that are not in table (none whose name begins with __)."""
        names = list(self.blocks) if wanted is None else list(wanted)
        phases, out = self.plan(names, table.columns), table
        passes = lambda blocks: [(b.needs, b.makes, b.run) for b in blocks]
        last = passes(phases.pop()[1]) if phases and phases[-1][0] == PASS else []
        for i, (kind, blocks) in enumerate(phases):
            out = kn.grouped(out, passes(blocks)) if kind == PASS else reduce(lambda t, b: b.run(t), blocks, out)
            if kind == DATE and (last or i + 1 < len(phases)):
                out = dealt(out)
        whole = set(self.named(n for n in names if n in self.blocks or n in self.groups))
        single = {n for n in names if n not in self.blocks and n not in self.groups}
        kept = [c for c, b in self.makers().items() if (b.name in whole or c in single) and c not in table.columns and not c.startswith("__")]
        needed = {*table.columns, *kept, *(c for needs, _, _ in last for c in needs)}
        return out.select(*(c for c in out.columns if c in needed)), last, kept
