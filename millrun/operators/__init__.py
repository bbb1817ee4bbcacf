"""DataFrame operators: ``f(df, ...) -> DataFrame``, lazy, no UDFs."""
