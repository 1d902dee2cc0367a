"""Rows that every operator must handle: null, empty, blank, very long and repeated texts, and a null id."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, mix_copies string"
ODD = [(1, None), (2, ""), (3, "   "), (None, "some text here of a few words"), (4, "x"), (5, "é" * 50), (6, "word " * 30_000), (7, "\x00퟿ \n\n"), (7, "\x00퟿ \n\n")]
