"""Engineering formulas. Closed forms are Column expressions (structs of named results) over any frame with the inputs as
columns or constants; what needs iteration or matrices is NumPy, for use on the driver or within a grouped kernel."""
