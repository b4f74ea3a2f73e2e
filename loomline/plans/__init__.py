"""Named queries over the test tables, with equivalent SQL where SQL can say it."""
