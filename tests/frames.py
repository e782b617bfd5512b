"""What the tests of the library share besides the session."""


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
