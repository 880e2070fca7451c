SF = "/root/testdata/sf0.001"
