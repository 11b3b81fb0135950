"""The given tables that tests read."""

SF = "/root/testdata/sf0.001"
