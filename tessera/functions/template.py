"""Templates with named slots: parsed once, filled as one Column."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


class Template:
    """Text with {named} slots; {{ and }} are braces. What fills a slot stays as it is, whatever it looks like.

    A slot is a plain name: positions, attributes, indexes, conversions and formats are errors, as are single braces.
    """

    def __init__(self, text: str):
        self.parts: list[tuple[str, bool]] = []
        for literal, slot, form, conversion in Formatter().parse(text):
            if literal and self.parts and not self.parts[-1][1]:  # a brace ends a literal for the parser
                self.parts[-1] = (self.parts[-1][0] + literal, False)
            elif literal:
                self.parts.append((literal, False))
            if slot is not None:
                if not slot.isidentifier() or form or conversion:
                    raise ValueError(f"not a plain slot: {{{slot}{'!' + conversion if conversion else ''}{':' + form if form else ''}}}")
                self.parts.append((slot, True))

    @property
    def slots(self) -> list[str]:
        """The names of the slots, each once, in the order of the text."""
        return list(dict.fromkeys(name for name, slot in self.parts if slot))

    def _checked(self, values: dict) -> dict:
        if unknown := sorted(set(values) - set(self.slots)):
            raise ValueError(f"the template has no slot {', '.join(unknown)}")
        if missing := [s for s in self.slots if s not in values]:
            raise ValueError(f"nothing fills the slot {', '.join(missing)}")
        return values

    def column(self, **values: Column) -> Column:
        """The filled text; a null value leaves its slot empty."""
        self._checked(values)
        return F.concat(F.lit(""), *(F.coalesce(values[t].cast("string"), F.lit("")) if slot else F.lit(t) for t, slot in self.parts))

    def fill(self, **values: str) -> str:
        self._checked(values)
        return "".join(values[t] if slot else t for t, slot in self.parts)

    def between(self, slot: str) -> tuple[str, str]:
        """The literals around the first place of a slot: by them its value is found again in a filled text."""
        at = self.parts.index((slot, True))
        literal = lambda i: self.parts[i][0] if 0 <= i < len(self.parts) and not self.parts[i][1] else ""
        return literal(at - 1), literal(at + 1)
