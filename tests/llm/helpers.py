"""Small tables with nulls, empty texts, ties, repeated rows and extra columns whose names operators use themselves."""

CLASH = "rank long, size long, key long, n long, node long, component long, target double, score double, shard int, kept boolean, __score double, __copy long, mix_copy long, pii_added int, whole_text string, grp string, x string, hash long, arc int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
_FILL = (1, 2, 3, 4, 5, 6, 7.0, 0.5, 9, False, 0.1, 2, 2, 5, "w", "g", "x", 8, 3)


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1]), *_FILL) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, sentence=12):
    out = []
    for i in range(n):
        w = "".join(rng.choice(WORDS)[: rng.randint(2, 6)] for _ in range(rng.randint(1, 2)))
        out.append(w.capitalize() if i % sentence == 0 else w)
        if i % sentence == sentence - 1:
            out[-1] += "."
            if rng.random() < 0.2:
                out[-1] += "\n"
    return " ".join(out)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "null id here"), (4, "one"), (5, "same text in two rows"), (6, "same text in two rows"), (7, "repeated row"), (7, "repeated row"), (8, None, None, None)]
