import pytest

#: Whitespace, case, accents, ties, repeated rows, nulls and long texts that every operator on documents must take.
ODD_TEXTS = [
    None, "", " ", "\n\t ", "a", "one two", "One two three four five", "one  two three\nfour five", "é ü ß ñ — 漢字 text",
    "The quick brown fox jumps over the lazy dog. " * 40, "The quick brown fox jumps over the lazy dog. " * 40, "x" * 70000, "word " * 9000,
    "Released under the MIT License. released UNDER the mit license", "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0 mit",
    "mail a.b@c.de, b@c, x@y.z@w.v or +1 (555) 123-4567 and 4111 1111 1111 1111 at 10.0.0.255.7.8.9.300 http://a.b/c?d=e",
    "password=abcdef123456 token = \"0123456789abcdef\" IBAN DE89370400440532013000", "1" * 3000 + " 1.2.3.4", "+1 +12 +1234567 +12345678 8-8",
]


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Odd rows, repeated ones, columns out of order and with names the operators use themselves."""
    rows = [(t, i * 3 % 41, ["en", None][i % 2], ["a", "b", None, ""][i % 4], len(t or ""), "x", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[9], rows[9]]
    return spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars long, size string, key int")
