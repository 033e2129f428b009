"""Errors by the names under which the queries' users know them."""


class KindError(ValueError):
    """An error with a name, such as InvalidQuery or NoIndexForQuery."""

    def __init__(self, name: str, detail: str = ""):
        super().__init__(f"{name}: {detail}" if detail else name)
        self.name = name
