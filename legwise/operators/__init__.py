"""DataFrame-to-DataFrame operators, parametrised by column names."""
