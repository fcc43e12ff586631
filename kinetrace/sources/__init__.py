"""Where tracks come from and go to."""
