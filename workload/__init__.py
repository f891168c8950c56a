"""The registered queries: the engine applied to the provided tables, with equivalent SQL."""
