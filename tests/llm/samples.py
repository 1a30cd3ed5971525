"""Rows that every operator must get through, and literal helpers."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and more" for i in range(60_000))


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, "The same first line here\nshort\nThe same first line here", "en", "src1", 10),
        (2, "  the SAME first line here \nsomething else that is long\n", "en", "src1", 10),
        (2, "  the SAME first line here \nsomething else that is long\n", "en", "src1", 10),
        (3, None, "en", "src1", None),
        (4, "", None, None, 0),
        (None, "the same first line here\nand a line of its own", "en", None, 3),
        (5, " \t\n \r\n", "fr", "a/b/c", 3),
        (6, LONG, "en", "a/b", len(LONG)),
        (7, "12345 !!! ###", "de", "", 3),
        (8, "été à l'école\n" * 3, "fr", "src2", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def collected(df, *columns):
    """Sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
