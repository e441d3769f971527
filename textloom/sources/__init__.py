"""Where texts come from: files, columns, standard input, and corpora of cases."""
