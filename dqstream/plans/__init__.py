"""Plan shapes shared by the operators: staging and running values."""
