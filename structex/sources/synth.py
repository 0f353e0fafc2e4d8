"""Seeded long documents with planted facts, for scoring an extraction end to end.

Planted entities come twice on both sides of a chunk boundary (the second time reworded, its code
spelled with a space), one scalar contradicts itself, and noise lines carry codes of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from random import Random

REGIONS = ("north", "south", "east", "west")
FORMATS = ("${:,.2f}", "USD {:.2f}", "{:,.2f} dollars")


@dataclass(frozen=True)
class Planted:
    sku: str
    description: str
    amount: float
    region: str


@dataclass(frozen=True)
class LongDocument:
    text: str
    planted: list[Planted]
    scalar_conflicts: list[tuple[str, float, float]]

    @property
    def char_count(self) -> int:
        return len(self.text)


def generate(seed: int = 42, pages: int = 56, planted_count: int = 40, chunk_size: int = 4000, page_chars: int = 2000) -> LongDocument:
    rng = Random(seed)
    codes = rng.sample(range(10_000, 99_999), planted_count + pages * 12)
    planted = [
        Planted(f"SKU-{c}", f"unit {rng.choice('ABCDEFGH')}{rng.randrange(100, 999)}", round(rng.uniform(10, 99_000), 2), rng.choice(REGIONS))
        for c in codes[:planted_count]
    ]
    noise = iter(codes[planted_count:])
    out = ["Annual report", "Total revenue: 4200000", ""]
    size = sum(len(x) + 1 for x in out)
    total, every = pages * page_chars, max(1, pages * page_chars // max(1, planted_count))
    waiting, again = list(planted), []

    def line(p: Planted, spelled: bool) -> str:
        code = p.sku.replace("-", " ") if spelled else p.sku
        return f"Transaction {code}: {p.description}, {rng.choice(FORMATS).format(p.amount)}, region {p.region}."

    due, contradicted = every // 2, False
    while size < total or waiting or again:
        if again and size % chunk_size < 300:
            new = line(again.pop(), True)
        elif waiting and size >= due:
            p = waiting.pop(0)
            new, due = line(p, False), due + every
            if len(planted) - len(waiting) <= max(1, planted_count // 5):
                again.append(p)
        elif not contradicted and size > total // 2:
            new, contradicted = "Total revenue: 4700000", True
        elif size >= total:
            new = line(again.pop(), True) if again else line(waiting.pop(0), False)
        else:
            code = next(noise, None)
            new = f"Transaction SKU-{code}: sundry, {rng.uniform(1, 500):.2f} dollars, region {rng.choice(REGIONS)}." if code and rng.random() < 0.3 else (
                "The quarter was in line with expectations and no further action was needed."
            )
        out.append(new)
        size += len(new) + 1
    return LongDocument("\n".join(out), planted, [("total_revenue", 4_200_000.0, 4_700_000.0)])
