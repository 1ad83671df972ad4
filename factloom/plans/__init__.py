"""Named queries over a directory of tables, with equivalent SQL."""
