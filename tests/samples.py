"""Values that several test modules share."""

AS_OF = "2026-06-01"
SF = "/root/testdata/sf0.001"
