"""Sources and sinks: JSON models and tables, source trees, framed logs, DOT graphs, ledgers."""
