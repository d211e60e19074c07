"""What is compared with what: an immutable similarity map."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class MatchSpec:
    """Ordered (left column, right column, similarity) triples.

    Built from ``{"name": ["levenshtein"], "a~b": [...]}``, from triples, or
    from another spec; ``a~b`` pairs columns of different names.
    """

    triples: tuple[tuple[str, str, str], ...]

    @classmethod
    def of(cls, spec) -> MatchSpec:
        if isinstance(spec, MatchSpec):
            return spec
        if isinstance(spec, Mapping):
            out = []
            for key, names in spec.items():
                sides = [x.strip() for x in key.split("~")]
                if len(sides) > 2 or not all(sides):
                    raise ValueError(f"a key is 'column' or 'left~right', not {key!r}")
                out += [(sides[0], sides[-1], n) for n in names]
            return cls(tuple(out))
        return cls(tuple((str(a), str(b), str(s)) for a, b, s in spec))

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        return iter(self.triples)

    def to_dict(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a, b, s in self.triples:
            out.setdefault(a if a == b else f"{a}~{b}", []).append(s)
        return out

    def association_sizes(self) -> list[int]:
        """Similarities per column pair, in order."""
        return [len(v) for v in self.to_dict().values()]

    @property
    def left_columns(self) -> list[str]:
        return list(dict.fromkeys(a for a, _, _ in self.triples))

    @property
    def right_columns(self) -> list[str]:
        return list(dict.fromkeys(b for _, b, _ in self.triples))

    @property
    def column_pairs(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys((a, b) for a, b, _ in self.triples))

    @property
    def features(self) -> list[str]:
        return [feature_name(*t) for t in self.triples]

    def restricted_to(self, features) -> MatchSpec:
        wanted = set(features)
        return MatchSpec(tuple(t for t in self.triples if feature_name(*t) in wanted))


def feature_name(left: str, right: str, similarity: str) -> str:
    return f"col_{left}_{right}_{similarity}"
