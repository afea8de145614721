"""Words for tests."""


def prose(rng, n):
    """``n`` words, of which few texts share five in a row."""
    return " ".join("".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))
