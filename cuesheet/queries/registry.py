"""A small registry: query name -> function, and its SQL twin."""


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if oracle:
                self.oracles[name] = oracle
            return fn

        return add
