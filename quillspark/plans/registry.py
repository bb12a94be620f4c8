"""How plan modules register their queries and the SQL beside them."""


def registry():
    """(queries, oracle, decorator): the decorator takes a name and, where SQL can say it, the SQL."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def put(f):
            queries[name] = f
            if sql:
                oracle[name] = " ".join(line.strip() for line in sql.strip().split("\n"))
            return f

        return put

    return queries, oracle, query
