"""The graph of tables: an edge from each dependent table to the one that it refers to. Small, so on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from veilspark.sources.catalog import ForeignKey


class Cyclic(ValueError):
    """Carries the layers found before the cycle."""

    def __init__(self, layers: list[list[str]], left: int):
        super().__init__(f"cycle: {left} tables cannot be ordered")
        self.layers = layers


class Graph:
    def __init__(self, nodes: Iterable[str] = (), edges: Iterable[tuple[str, str]] = ()):
        self.needs: dict[str, set[str]] = {}
        for n in nodes:
            self.add_node(n)
        for a, b in edges:
            self.add_edge(a, b)

    @classmethod
    def of(cls, tables: Iterable[str], keys: Iterable[ForeignKey]) -> Graph:
        return cls(tables, ((k.from_table, k.to_table) for k in keys))

    def add_node(self, name: str) -> None:
        self.needs.setdefault(name, set())

    def add_edge(self, dependent: str, on: str) -> None:
        self.add_node(dependent)
        self.add_node(on)
        self.needs[dependent].add(on)

    def nodes(self) -> list[str]:
        return sorted(self.needs)

    def parents_of(self, table: str) -> list[str]:
        return sorted(self.needs.get(table, ()))

    def children_of(self, table: str) -> list[str]:
        return sorted(n for n, on in self.needs.items() if table in on)

    def layers(self) -> list[list[str]]:
        """Tables without dependencies first. On a cycle, self-references included, raises with the partial layers."""
        left = {n: set(on) for n, on in self.needs.items()}
        out = []
        while left:
            ready = sorted(n for n, on in left.items() if not on)
            if not ready:
                raise Cyclic(out, len(left))
            out.append(ready)
            for n in ready:
                del left[n]
            for on in left.values():
                on.difference_update(ready)
        return out

    def _groups(self) -> list[list[str]]:
        """Strongly connected components: the nodes that reach each other, by forward and backward search from one."""
        back: dict[str, set[str]] = {n: set() for n in self.needs}
        for n, on in self.needs.items():
            for m in on:
                back[m].add(n)

        def reach(start: str, edges: dict[str, set[str]]) -> set[str]:
            seen, todo = {start}, [start]
            while todo:
                for m in edges[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            return seen

        left, out = set(self.needs), []
        for n in sorted(self.needs):
            if n in left:
                group = reach(n, self.needs) & reach(n, back)
                left -= group
                out.append(sorted(group))
        return out

    def cycles(self) -> list[list[str]]:
        """Groups of two tables or more; a table that refers to itself only is none."""
        return sorted(g for g in self._groups() if len(g) > 1)

    def restore_layers(self) -> list[list[list[str]]]:
        """Layers of groups, every table included: a cycle is one group, references to itself are ignored."""
        groups = self._groups()
        of = {n: i for i, g in enumerate(groups) for n in g}
        condensed = Graph((str(i) for i in range(len(groups))), ((str(of[n]), str(of[m])) for n, on in self.needs.items() for m in on if of[n] != of[m]))
        return [sorted(groups[int(i)] for i in layer) for layer in condensed.layers()]
