"""Quotes are located without a list of places as long as the text."""

import tracemalloc

from structex.operators.cite import locate


def test_a_long_source_takes_little_memory():
    sources = ["".join(f"Word{i}  \n {n} " for i in range(20_000)) for n in range(8)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    found = [locate("word19999 7 ", s) or locate("WORD19999", s) for s in sources]
    held, most = (m - before for m in tracemalloc.get_traced_memory())
    tracemalloc.stop()
    assert all(s[a:b].lower().startswith("word19999") for s, (a, b) in zip(sources, found, strict=True))
    assert held < 2 * len(sources[0]) and most < 8 * len(sources[0])


def test_places_behind_letters_that_grow():
    assert locate("straße  İX", "İİ  a STRAẞE\n\tİx!") == (6, 16)
    assert locate("ασ b", "ΟΔΟΣ  ΑΣ \n B") == (6, 12)
